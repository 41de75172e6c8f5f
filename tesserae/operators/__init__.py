"""Operators: each takes and returns DataFrames for all queries or documents at once."""
