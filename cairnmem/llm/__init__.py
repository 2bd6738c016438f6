"""Operators of a training-data pipeline: dedup, decontamination, scoring, packing, sharding.

Nothing else in the library imports this subpackage.
"""
