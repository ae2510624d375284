"""Spark-native website audit engine and training-data operators."""
