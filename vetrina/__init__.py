"""Product-catalogue analytics on Spark DataFrames."""
