"""Sparse count-matrix factor analytics expressed as Spark DataFrames."""
