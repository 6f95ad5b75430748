"""Operators: DataFrames in and out."""
