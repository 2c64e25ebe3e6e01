"""foldmark: content-overlap analytics on Spark DataFrames."""
