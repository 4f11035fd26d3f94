"""Leakage-resistant dataset preparation, auditing and retrieval evaluation on Spark DataFrames."""
