"""Tidemark: distribution shift and point anomalies in tables, on Spark DataFrames."""
