"""confero: record comparison and linkage on Spark DataFrames."""
