"""Column expressions: text, paths, JSON, vectors, status rules."""
