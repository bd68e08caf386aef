"""Starweave: a PySpark-native semantic-layer analytics engine."""

__version__ = "0.1.0"
