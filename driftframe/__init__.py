"""Gridded image time series on Spark: detect, segment, track and aggregate moving objects."""

__version__ = "0.1.0"
