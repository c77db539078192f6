"""Portfolio analytics on Spark DataFrames: long panels in, long panels out."""
