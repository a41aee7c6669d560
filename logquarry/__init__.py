"""logquarry: log analytics on PySpark DataFrames and Structured Streaming."""
