"""Governed analytics on Spark: masking, discovery, policy, audit and integrity work as DataFrame jobs."""

__version__ = "0.1.0"
