"""Relational operators, each a function of DataFrames."""
