"""Spark-native text and code intelligence engine."""
