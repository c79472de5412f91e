"""Column expressions: text, distance, geometry, names."""
