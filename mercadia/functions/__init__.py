"""Column expressions and parameters shared by the operators."""
