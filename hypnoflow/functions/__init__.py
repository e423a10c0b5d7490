"""Column functions and filter design."""
