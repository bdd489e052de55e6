"""Chunked N-dimensional arrays and the metadata around them, on Spark DataFrames."""
