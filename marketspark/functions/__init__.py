"""Column expressions: one row in, one row out."""
