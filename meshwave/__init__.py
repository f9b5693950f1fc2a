"""Spark-native random-field analytics."""
