"""Column expressions: text, vectors, table structure."""
