"""Call-scoring analytics on Spark DataFrames."""
