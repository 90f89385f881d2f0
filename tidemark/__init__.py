"""tidemark: versioned time-series evidence operators for Spark DataFrames and streams."""
