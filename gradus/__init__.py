"""Hierarchical pattern analytics on Spark DataFrames."""
