"""vecspark: vector similarity analytics and data preparation on Spark DataFrames."""
