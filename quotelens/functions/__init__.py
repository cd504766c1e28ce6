"""Column expressions: features, similarity score, small statistics."""
