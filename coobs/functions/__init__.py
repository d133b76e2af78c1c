"""Column expressions: numbers, text keys and tokens, row-local sequences."""
