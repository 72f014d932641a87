"""Sources of the scoring engine."""
