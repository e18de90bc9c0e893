"""Structured Streaming forms of the operators; each has a batch twin with the same result."""
