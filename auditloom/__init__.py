"""Host-audit threat analytics on Spark DataFrames."""
