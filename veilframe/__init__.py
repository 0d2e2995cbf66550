"""Privacy operators on Spark DataFrames."""
