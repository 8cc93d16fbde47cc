"""Distributed operators: DataFrames in, DataFrame out."""
