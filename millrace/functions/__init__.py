"""Column functions over text, paths and names."""
