"""Research-evidence analytics on Spark DataFrames."""
