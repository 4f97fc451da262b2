"""Operators of a training-data pipeline: tokenizing, deduplication, filtering, packing, output."""
