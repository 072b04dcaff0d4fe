"""Training-data operators: dedup, filtering, formatting, packing, sharding, archives."""
