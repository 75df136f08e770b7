"""Agent-memory analytics on PySpark DataFrames."""
