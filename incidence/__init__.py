"""Incident and event analytics expressed as lazy Spark DataFrame plans."""
