"""weftline: weighted-trajectory analytics on Spark DataFrames."""
