"""talkloom: conversation and corpus analytics on Spark DataFrames."""
