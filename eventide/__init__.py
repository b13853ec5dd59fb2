"""Point-in-time event research on Spark DataFrames."""
