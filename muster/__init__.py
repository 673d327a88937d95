"""Fleet analytics on Spark: every public operator takes DataFrames and column names and returns a DataFrame."""
