"""Column expressions: coercions, similarity, decay."""
