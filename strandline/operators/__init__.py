"""Operators of the scoring engine."""
