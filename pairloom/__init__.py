"""pairloom: aligned-text quality analytics on PySpark DataFrames."""
