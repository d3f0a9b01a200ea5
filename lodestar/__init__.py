"""Spark-native analytics over code, document and note corpora."""

__version__ = "0.1.0"
