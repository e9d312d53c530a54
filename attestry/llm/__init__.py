"""Operators of a training-data pipeline: deduplication, scoring, filtering, mixing, sharding."""
