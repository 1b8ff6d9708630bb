"""Time-series, signal and event analytics on Spark DataFrames."""
