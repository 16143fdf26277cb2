"""Spark-native news and event analytics engine."""

__version__ = "0.1.0"
