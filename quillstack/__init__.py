"""Spark-native analytics for a personal document archive."""
