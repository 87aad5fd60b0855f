"""Frame-series feature engine on Spark DataFrames."""
