"""Inventory analytics on Spark DataFrames."""
