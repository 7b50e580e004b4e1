"""Structured Streaming jobs; each reuses the batch operators."""
