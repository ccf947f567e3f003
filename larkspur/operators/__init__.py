"""Operators over DataFrames, free of table names."""
