"""Column functions: every function takes columns (or names) and returns a Column."""
