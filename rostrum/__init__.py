"""Meeting-transcript analytics and retrieval on Spark DataFrames."""
