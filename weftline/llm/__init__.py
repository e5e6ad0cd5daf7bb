"""Operators of a training-data pipeline: scans, filters, scoring, sharding, packing, mixing, deduplication."""
