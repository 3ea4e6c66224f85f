"""Rasterloom: lossless raster and clip coding, and the analytics around it, on Spark DataFrames."""

__version__ = "0.1.0"
