"""Market-tick analytics on Spark DataFrames."""
