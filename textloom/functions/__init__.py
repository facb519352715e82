"""Column functions: text, scores, fuzzy evidence."""
