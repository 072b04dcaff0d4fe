"""Operators that Spark has no built-in for: density clustering, nearest roads."""
