"""Hybrid search, catalogue, feedback and ranking analytics on Spark DataFrames."""
