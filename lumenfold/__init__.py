"""Spatial capture analytics on Spark DataFrames."""
