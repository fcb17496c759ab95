"""Marketplace analytics engine on PySpark DataFrames."""
