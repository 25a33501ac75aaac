"""Column expressions and fixed texts shared by the plans."""
