"""Market-data analytics on Spark: every operator takes and returns DataFrames keyed by symbol."""
