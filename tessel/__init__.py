"""Embedding retrieval and training data on Spark DataFrames."""
