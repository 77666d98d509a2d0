"""Page-preparation analytics as Spark DataFrames."""
