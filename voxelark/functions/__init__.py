"""Column expressions and small driver-side tables."""
