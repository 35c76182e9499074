"""Planar geometry, graph and event analytics on Spark DataFrames."""
