"""Scalar functions as Column expressions with the warehouse's semantics (NULL rules, guards, prefix parsing)."""
