"""Web content audit analytics on Spark DataFrames."""
