"""End-to-end plans composed from the operators (X1-X5, F1-F5, tables, comments)."""
