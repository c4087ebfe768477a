"""Operators of a training-data pipeline: extraction, search, filtering, deduplication, mixing, packing, formatting.

Nothing else in the library imports this subpackage.
"""
