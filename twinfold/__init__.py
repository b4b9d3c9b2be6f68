"""Duplicate-content analytics on Spark DataFrames."""
