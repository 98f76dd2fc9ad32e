"""Multi-camera identity analytics on Spark DataFrames."""
