"""Operators for training data: filters, mixing, deduplication, search, archives, tokens, scoring."""
