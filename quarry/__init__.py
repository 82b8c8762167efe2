"""quarry: an analytical query engine on Spark DataFrames and Spark SQL."""
