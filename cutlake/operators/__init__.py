"""Operator families: every function takes DataFrames and returns a DataFrame, lazily."""
