"""Structured Streaming jobs; each one has a batch twin in ``rostrum.operators``."""
