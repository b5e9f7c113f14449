"""Column expressions, fixed values and join/rank helpers."""
