"""Graph and similarity analytics on Spark DataFrames."""
