"""Column expressions: keyed draws, statistics and classification scores."""
