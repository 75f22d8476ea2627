"""Spark-native analytics over corpora of threat-intelligence reports."""

__version__ = "0.1.0"
