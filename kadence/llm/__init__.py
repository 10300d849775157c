"""Operators for preparing language-model training text, each on plain DataFrames."""
