"""Operators for large-scale training-data pipelines; independent of the rest of the library."""
