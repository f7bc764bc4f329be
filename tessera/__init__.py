"""Spark-native knowledge retrieval and analytics engine."""
