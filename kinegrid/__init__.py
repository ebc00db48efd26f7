"""Analytics for ordered, multi-channel measurement series, on PySpark."""
