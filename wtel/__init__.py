"""Workload telemetry analytics on Spark."""
