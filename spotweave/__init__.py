"""Spark-native analytics for expression measured at located spots."""
