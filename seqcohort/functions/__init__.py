"""Column expressions: alphabets, string helpers, model formulas, tail probabilities."""
