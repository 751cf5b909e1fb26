"""Spark-native detector evaluation and feature analytics."""

__version__ = "0.1.0"
