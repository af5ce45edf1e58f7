"""Column expressions: endpoint, time and address features."""
