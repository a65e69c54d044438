"""DataFrames in, a DataFrame out."""
