"""Incident telemetry analytics on Spark: pure functions from DataFrames to DataFrames."""
