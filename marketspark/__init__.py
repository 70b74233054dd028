"""marketspark: market time-series analytics written as Spark jobs."""
