"""Column builders for ordered series."""
