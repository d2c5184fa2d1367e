"""Column expressions and text forms of values."""
