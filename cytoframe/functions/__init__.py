"""Column expressions: names, paths and scalar formulas."""
