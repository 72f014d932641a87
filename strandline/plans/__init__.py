"""Plans of the scoring engine."""
