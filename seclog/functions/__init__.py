"""Column expressions. Each takes columns and returns a column."""
