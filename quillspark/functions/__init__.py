"""Column functions: scalar text, date, hash and arithmetic expressions."""
