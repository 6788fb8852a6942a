"""Content-relationship analytics on Spark DataFrames."""
