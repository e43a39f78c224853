"""Operators over DataFrames: graph patterns and paths, causal analysis, similarity search, columns, text, relations."""
