"""Raster map algebra on Spark DataFrames."""
