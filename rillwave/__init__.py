"""Spark-native biosignal analytics: recordings in, epoch features, scores and early warnings out."""

__version__ = "0.1.0"
