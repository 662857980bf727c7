"""Chaptering and temporal retrieval over many recordings, as DataFrame operators."""

__version__ = "0.1.0"
