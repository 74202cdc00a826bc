"""Analytics over block-ordered event logs, as Spark DataFrames."""
