"""Column functions: missing values, text, numbers, conditions, similarity, geometry."""
