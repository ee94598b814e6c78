"""Timed-text analytics on Spark: sessionization, alignment and text-quality operators."""

__version__ = "0.1.0"
