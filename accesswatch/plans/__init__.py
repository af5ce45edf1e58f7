"""The reference paths end to end: features, training, scoring, reporting, diagnostics."""
