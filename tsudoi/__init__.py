"""Event catalogue engine on Spark: every operator maps DataFrames to a DataFrame."""
