"""Spark-native analytics for very large media libraries."""
