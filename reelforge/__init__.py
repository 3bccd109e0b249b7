"""Spark-first toolkit that builds and evaluates next-frame-prediction data."""
