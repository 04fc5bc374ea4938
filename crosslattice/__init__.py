"""Taxonomy alignment analytics on Spark DataFrames."""
