"""Operators for training-data pipelines: deduplication, filters, mixing, tokens, media, vectors."""
