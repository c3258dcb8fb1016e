"""Parasitics analytics on Spark DataFrames."""
