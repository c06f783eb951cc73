"""ledgerloom: ledger analytics and training-data operators on Spark DataFrames."""
