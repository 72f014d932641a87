"""Streaming of the scoring engine."""
