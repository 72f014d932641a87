"""Functions of the scoring engine."""
