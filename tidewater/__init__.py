"""Document retrieval and corpus preparation on Spark DataFrames."""
