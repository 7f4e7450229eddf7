"""Column functions: canonical symbols, normalized observations, redaction, statistics."""
