"""Evidence analytics on Spark: files, facts, graphs and findings as DataFrames."""

__version__ = "0.1.0"
