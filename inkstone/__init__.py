"""Preparing, encoding and scoring text-recognition data with Spark DataFrames."""
