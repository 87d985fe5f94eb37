"""Sequence-library analytics on Spark DataFrames."""
