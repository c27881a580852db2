"""Table operators: every function maps a DataFrame to a DataFrame."""
