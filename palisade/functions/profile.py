"""One-pass per-column profiles of wide tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns per aggregate: a few hundred expressions still compile well, and each part of a very
# wide table reads only its own columns.
COLUMNS_PER_PASS = 100


def per_column(
    df: DataFrame,
    names: Sequence[str],
    aggregates: Callable[[int, str], list[Column]],
    row: Callable[[int, str], Column],
) -> DataFrame:
    """One output row per column: `aggregates` over all rows, then `row` over their results."""
    indexed = list(enumerate(names))
    parts = []
    for start in range(0, len(indexed), COLUMNS_PER_PASS):
        some = indexed[start : start + COLUMNS_PER_PASS]
        wide = df.agg(*[a for i, n in some for a in aggregates(i, n)])
        parts.append(wide.select(F.inline(F.array(*[row(i, n) for i, n in some]))))
    if not parts:
        raise ValueError("no column to profile")
    return reduce(DataFrame.unionByName, parts)
