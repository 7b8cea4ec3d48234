"""Operators for training-data pipelines: deduplication, filtering, tokenizing, packing and extraction."""
