"""Spark-native engine for hierarchical documents, hybrid retrieval and corpus preparation."""
