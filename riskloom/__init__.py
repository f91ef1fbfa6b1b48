"""riskloom: registry risk analytics and corpus preparation on Spark DataFrames."""
