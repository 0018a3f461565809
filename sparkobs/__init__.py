"""Telemetry analytics on Spark DataFrames: spans, logs and metrics as declarative plans."""
