"""Disclosure-change analytics on Spark: versioned passages, tagged facts, and the questions asked about them."""

__version__ = "0.1.0"
