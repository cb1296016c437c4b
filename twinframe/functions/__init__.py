"""Column expressions: names, text normalisers, value coercion."""
