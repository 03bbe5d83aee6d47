"""Spark-native text and code retrieval analytics."""
