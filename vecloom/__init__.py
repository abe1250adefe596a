"""vecloom: vector-cloud analytics and corpus preparation as Spark DataFrames."""
