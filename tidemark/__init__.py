"""Spark-native analytics for daily market series and large-scale training data."""

__version__ = "0.1.0"
