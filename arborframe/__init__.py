"""Tree-inventory analytics on Spark DataFrames."""
