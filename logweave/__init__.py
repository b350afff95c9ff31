"""Analytics over very large ordered logs, expressed as Spark DataFrames."""
