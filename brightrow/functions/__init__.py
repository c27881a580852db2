"""Column expressions: every function here maps a Column to a Column."""
