"""DataFrame operators: rates, rules, encoders, reports, metrics, detectors, models."""
