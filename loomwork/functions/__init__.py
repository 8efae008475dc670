"""Column functions: text, places and numbers, scores."""
