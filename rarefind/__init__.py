"""Finding rare events in large tables with Spark DataFrames and Spark ML."""
