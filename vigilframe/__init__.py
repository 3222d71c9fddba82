"""Table monitoring and data quality on Spark DataFrames."""
