"""Frame-level detection analytics on Spark DataFrames."""
