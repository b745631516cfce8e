"""Column functions without a place among the operators."""
