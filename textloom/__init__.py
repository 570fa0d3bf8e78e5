"""Spark-native repository and corpus analytics."""
