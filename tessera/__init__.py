"""Hybrid document retrieval and text analytics as PySpark DataFrames."""
