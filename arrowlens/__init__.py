"""Typed attributed property graphs and large table reshaping on Spark DataFrames."""

__version__ = "0.1.0"
