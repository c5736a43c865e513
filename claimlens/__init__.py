"""claimlens: checking stated figures against reference data, on Spark DataFrames."""
