"""lexspan: document-risk analytics expressed on Spark DataFrames."""
