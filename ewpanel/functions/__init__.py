"""Column expressions: keys, text and scalars."""
