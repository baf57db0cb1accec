"""Meridian: a Spark-native intelligence-fusion and analytics engine."""

__version__ = "0.1.0"
