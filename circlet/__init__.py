"""Circular range queries over point tables, on Spark."""
