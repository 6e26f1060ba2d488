"""Analytics over linked records, expressed as Spark DataFrames."""
