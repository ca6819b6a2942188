"""Spark-native table profiling, cleaning and analytics."""
