"""Operators for large-scale training-data pipelines (deletable as a whole)."""
