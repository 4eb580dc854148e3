"""Sensitive-data inspection, policy analytics and corpus preparation on Spark DataFrames."""
