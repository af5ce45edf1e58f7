"""Operators of a training-data pipeline: quality, decontamination, deduplication, packing."""
