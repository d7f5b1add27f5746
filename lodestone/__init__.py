"""Spark-first evaluation analytics."""
