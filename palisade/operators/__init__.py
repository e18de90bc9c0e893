"""Operator families: DataFrame in, DataFrame out."""
