"""Mesh-network telemetry analytics on PySpark DataFrames."""
