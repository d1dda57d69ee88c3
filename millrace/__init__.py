"""Spark-native retrieval, table and corpus engine."""
