"""Column functions: text, scores, money and templates."""
