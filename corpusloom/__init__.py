"""Analysis of text corpora and the graphs hidden in them, on Spark DataFrames."""
