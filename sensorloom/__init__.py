"""Spark-native analytics for wearable sensor recordings."""
