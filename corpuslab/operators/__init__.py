"""Relational operators of the corpus engine, each a function from DataFrames to a DataFrame."""
