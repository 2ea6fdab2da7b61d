"""Snapshot analytics on Spark: classify, filter, redact, select, pack and verify collections of texts."""

__version__ = "0.1.0"
