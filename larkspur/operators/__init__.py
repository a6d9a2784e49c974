"""Relational operators: DataFrame in, DataFrame or Column out."""
