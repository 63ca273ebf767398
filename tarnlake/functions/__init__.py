"""Scalar functions, distributions and formulas."""
