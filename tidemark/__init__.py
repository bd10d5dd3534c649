"""Spark-native engine for privacy-preserving traffic and error insights."""
