"""Per-read sequencing analytics and corpus preparation on Spark DataFrames."""
