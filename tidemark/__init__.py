"""As-of analytics on Spark DataFrames."""
