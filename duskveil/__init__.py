"""Privacy analytics on Spark DataFrames."""
