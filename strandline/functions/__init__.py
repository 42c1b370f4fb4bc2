"""Column functions without a table of their own."""
