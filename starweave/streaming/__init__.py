"""Metric views over streams: an extension."""
