"""Amplicon read analytics on Spark DataFrames."""
