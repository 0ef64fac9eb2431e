"""Column functions: vector arithmetic, validation, parsing."""
