"""Evidence processing on Spark DataFrames."""
