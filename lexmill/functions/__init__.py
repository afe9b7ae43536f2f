"""Column expressions: text, labels and scores."""
