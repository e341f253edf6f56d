"""Operators on the data model: each a function from DataFrames to a DataFrame."""
