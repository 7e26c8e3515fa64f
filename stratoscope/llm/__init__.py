"""Operators of a large-scale training-data pipeline, as Spark jobs over a documents table."""
