"""Batch evidence retrieval and knowledge-base analytics as Spark DataFrame jobs."""

__version__ = "0.1.0"
