"""Operational analytics on Spark: task outliers, table file history, batch inference, streaming progress."""

__version__ = "0.1.0"
