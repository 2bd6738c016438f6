"""Column functions: vectors, scores, text."""
