"""Gated memory retrieval on Spark: plans, operators, sources, streaming."""

__version__ = "0.1.0"
