"""Operators of a training-data pipeline: packing, tokens, quality, deduplication, extraction."""
