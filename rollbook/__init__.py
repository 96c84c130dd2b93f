"""Analytics over versioned public records, written with Spark DataFrames."""
