"""Spark-native statistical learning: estimators, metrics, splitters and text features over DataFrames."""

__version__ = "0.1.0"
