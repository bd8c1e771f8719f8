"""Geometric nearest-neighbour search and related table jobs as Spark DataFrame work."""
