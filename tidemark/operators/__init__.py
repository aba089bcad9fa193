"""Operators: each takes DataFrames and a small specification and returns a DataFrame."""
