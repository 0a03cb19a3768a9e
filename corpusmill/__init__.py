"""Spark-native analytics over versioned document and code corpora."""

__version__ = "0.1.0"
