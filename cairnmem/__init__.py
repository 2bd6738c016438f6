"""Cognitive-memory analytics expressed as PySpark DataFrames."""
