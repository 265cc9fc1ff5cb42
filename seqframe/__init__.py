"""Ordered sequences as Spark DataFrames."""
