"""Source-tree corpus preparation on Spark DataFrames."""
