"""Operators of a training-data pipeline: deduplication, filters, mixing, sharding, token counts and fingerprints."""
