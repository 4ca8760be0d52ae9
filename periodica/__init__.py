"""Spark-first analytics for dominant cycles of many time series."""
