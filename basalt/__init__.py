"""Basalt: relational property-graph analytics written as PySpark DataFrame programs."""
