"""Spark-native analytics for labelled short texts."""

__version__ = "0.1.0"
