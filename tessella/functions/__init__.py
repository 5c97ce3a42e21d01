"""Statistics as column expressions, and solvers in NumPy."""
