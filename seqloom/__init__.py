"""Sequence, k-mer and interval analytics on Spark DataFrames."""
