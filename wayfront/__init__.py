"""Multi-objective route analytics on Spark DataFrames."""
