"""Declarative feature preparation on Spark DataFrames."""
