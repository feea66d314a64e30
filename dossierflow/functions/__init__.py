"""Column -> Column expressions shared by the operators."""
