"""tokenguard: token-uncertainty scoring, grounded retrieval and text screening on Spark DataFrames."""
