"""Registered queries: the operators composed over the given tables, each with its check SQL."""
