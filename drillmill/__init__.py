"""Spark-first extraction, cleaning and evaluation of drill forms."""

__version__ = "0.1.0"
