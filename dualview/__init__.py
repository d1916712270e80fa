"""Spark-native analytics for two-source label reliability."""
