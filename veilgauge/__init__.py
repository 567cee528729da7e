"""Privacy and quality analytics over Spark DataFrames."""
