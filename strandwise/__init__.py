"""Suffix, substring and text-index analytics on PySpark DataFrames."""
