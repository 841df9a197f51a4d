"""Column expressions: hashing, text, scores."""
