"""Operators of a training-data pipeline: tokens, packing, deduplication, search and filters."""
