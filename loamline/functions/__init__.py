"""Column expressions shared by the operators; built-in functions only."""
