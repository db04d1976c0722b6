"""Spark-native analytics for document corpora and their bibliographic metadata."""
