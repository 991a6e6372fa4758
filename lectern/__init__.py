"""Lectern: corpus building, hybrid retrieval, evaluation and assessment checks on Spark."""

__version__ = "0.1.0"
