"""Retrieval analytics and corpus preparation as set-at-a-time Spark plans."""

__version__ = "0.1.0"
