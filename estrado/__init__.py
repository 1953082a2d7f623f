"""Hybrid retrieval and legal-text analytics on Spark DataFrames."""
