"""Spatial program analytics over tiles and their components, as Spark DataFrames."""
