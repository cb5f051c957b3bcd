"""Spark-native ingestion, retrieval and retrieval-evaluation over statute corpora."""
