"""Corpus mixing and token windows as Spark DataFrame jobs."""

__version__ = "0.1.0"
