"""Recursion over rows: each round works on what the round before has found, and is written to the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.session import materialize


def recurse(seed: DataFrame, step: Callable[[DataFrame], DataFrame], distinct: bool = False, round_column: str | None = None) -> DataFrame:
    """The rows of `seed`, and of `step` over the rows of the round before, until a round finds none.

    `step` takes and returns rows with the columns of `seed`. With `distinct` a row counts once and goes on once, as in a
    recursive UNION, so cycles end; without it, as in UNION ALL, it is up to `step` to end. `round_column` adds the number of
    the round, from 0. A round reads the one before and, where rows are distinct, all found so far; nothing is kept in memory.
    """
    columns, number = seed.columns, 0
    rows = materialize(seed.distinct() if distinct else seed, "recursion")
    found = rows.withColumn("__round", F.lit(0))
    while not rows.isEmpty():
        onward, number = step(rows).select(*columns), number + 1
        if distinct:
            onward = _without(onward.distinct(), found.select(*columns))
        rows = materialize(onward, "recursion")
        found = found.unionByName(rows.withColumn("__round", F.lit(number)))
    return found.drop("__round") if round_column is None else found.withColumnRenamed("__round", round_column)


def _without(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Rows that the others do not hold, null equal to null."""
    side = others.select(*[F.col(c).alias(f"__{c}") for c in rows.columns])
    return rows.join(side, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in rows.columns], "left_anti")


def leading_into_cycles(edges: DataFrame, start: str, end: str) -> DataFrame:
    """The distinct starts from which some path of `edges` never ends.

    Edges whose end starts no edge any more are taken off, round by round; what stays leads into a cycle. At most as
    many rounds as the longest path without one, and no pairs but the edges themselves.
    """
    left = materialize(edges.select(start, end).filter(F.col(start).isNotNull() & F.col(end).isNotNull()).distinct(), "cycles")
    n = left.count()
    while n:
        kept = materialize(left.join(left.select(F.col(start).alias(end)).distinct(), end, "left_semi"), "cycles")
        now = kept.count()
        if now == n:
            break
        left, n = kept, now
    return left.select(start).distinct()
