"""Document-to-ledger analytics on Spark DataFrames."""
