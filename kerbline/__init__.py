"""Street-network analytics on Spark DataFrames."""
