"""Schemas, rule tables, readers and writers."""
