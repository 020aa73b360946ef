"""Column functions: text, numbers, codes, dates."""
