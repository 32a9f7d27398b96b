"""Operators for large-scale training-data pipelines, with their queries. Nothing else in the library imports this package."""
