"""Spark-native analytics over dialogue corpora."""
