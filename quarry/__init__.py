"""Quarry: post-training data analytics on PySpark DataFrames."""
