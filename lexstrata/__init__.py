"""Spark-native curation and analysis of document corpora."""
