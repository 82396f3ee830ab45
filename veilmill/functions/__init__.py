"""Column expressions: keyed randomness, vector arithmetic and text handling."""
