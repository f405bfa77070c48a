"""Column functions: derive expressions, interval relations, exact rounding."""
