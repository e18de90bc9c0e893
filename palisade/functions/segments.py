"""Per-key ordered work that stays even when one key holds a large share of all rows.

A plain `Window.partitionBy(key)` puts a hot key into one task. Here each key is cut into
time slices: the window runs inside (key, slice), and only one small row per slice crosses
the slice borders. A null key is a key and a null time a slice, which comes first: no row is lost.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def time_slice(ts: str, unit: str = "hour") -> Column:
    return F.date_trunc(unit, F.col(ts))


def join_same(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys where null equals null; the keys stay once, as the left side has them."""
    side = other.select(*[F.col(c).alias(f"__same_{c}") if c in keys else F.col(c) for c in other.columns])
    same = [F.col(c).eqNullSafe(F.col(f"__same_{c}")) for c in keys]
    return df.join(side, same, how).drop(*[f"__same_{c}" for c in keys])


def _slice_key(keys: Sequence[str], slice_col: Column) -> Column:
    """Keys and slice as one struct: it is never null itself, so rows with null keys or times meet their slice too."""
    return F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], slice_col.alias("slice"))


def _across(keys: Sequence[str]) -> WindowSpec:
    """All slices of a key in order; a null slice comes first, as null times do."""
    return Window.partitionBy(*[F.col(f"__segment.k{i}") for i in range(len(keys))]).orderBy("__segment.slice")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slice_col: Column,
    value: Column,
    out: str,
) -> DataFrame:
    """Inclusive running sum of `value` per key in `order`, as two levels of sums."""
    cut = df.withColumn("__segment", _slice_key(keys, slice_col)).withColumn("__v", value)
    inside = Window.partitionBy("__segment").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = _across(keys).rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        cut.groupBy("__segment")
        .agg(F.sum("__v").alias("__t"))
        .withColumn("__before", F.coalesce(F.sum("__t").over(before), F.lit(0)))
        .drop("__t")
    )
    return (
        cut.withColumn("__in", F.sum("__v").over(inside))
        .join(totals, "__segment")
        .withColumn(out, F.col("__in") + F.col("__before"))
        .drop("__segment", "__v", "__in", "__before")
    )


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_col: Column, out: str) -> DataFrame:
    return running(df, keys, order, slice_col, F.lit(1).cast("bigint"), out)


def previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slice_col: Column,
    columns: Sequence[str],
    prefix: str = "prev_",
) -> DataFrame:
    """The preceding row's columns per key in `order`; slice borders are bridged by last rows."""
    cut = df.withColumn("__segment", _slice_key(keys, slice_col))
    inside = Window.partitionBy("__segment").orderBy(*order)
    carried = F.struct(*[F.col(c).alias(c) for c in columns])
    last = (
        cut.groupBy("__segment")
        .agg(F.max_by(carried, F.struct(*[F.col(c) for c in order])).alias("__last"))
        .withColumn("__bridge", F.lag("__last").over(_across(keys)))
        .drop("__last")
    )
    joined = cut.withColumn("__prev", F.lag(carried).over(inside)).join(last, "__segment")
    picked = F.coalesce("__prev", "__bridge")
    return joined.select(
        *[F.col(c) for c in df.columns], *[picked.getField(c).alias(prefix + c) for c in columns]
    )
