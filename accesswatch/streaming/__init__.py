"""Structured Streaming: windowed figures, deduplication, scoring of micro-batches."""
