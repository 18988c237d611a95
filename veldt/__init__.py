"""Veldt: climate, survey and corpus analytics on Spark DataFrames."""
