"""Operators for training data: each is a DataFrame operator with its own query."""
