"""Affinity analytics on Spark DataFrames: every operator is a function from DataFrames to DataFrames."""
