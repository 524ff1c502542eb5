"""Network-accessibility and data-processing analytics on Spark DataFrames."""
