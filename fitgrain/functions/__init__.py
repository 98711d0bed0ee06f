"""Column expressions and distributed numeric building blocks."""
