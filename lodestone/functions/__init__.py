"""Column functions: numbers, names, keys and geometry."""
