"""Comparative-genomics table operators for Spark DataFrames."""
