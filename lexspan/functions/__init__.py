"""Column functions and small DataFrame helpers shared by the operators."""
