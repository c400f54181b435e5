"""Spark-native analytics over source code and text corpora."""

__version__ = "0.1.0"
