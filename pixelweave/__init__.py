"""Raster analytics and text-corpus preparation on Spark DataFrames."""
