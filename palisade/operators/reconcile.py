"""Digests of frames, copies compared, bulk merges, retention and the outbox projection."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.hashing import row_digest, set_digest
from palisade.functions.segments import running, time_slice
from palisade.session import materialize


def _text_columns(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def frame_digest(df: DataFrame, truncated: bool = False) -> DataFrame:
    """Row count and order-free digest of a frame, its field names and its truncation flag included."""
    names = ",".join(df.columns) + ("|truncated" if truncated else "")
    content = set_digest(row_digest(df.columns))
    digest = _text_columns(df).agg(F.count(F.lit(1)).alias("rows"), content.alias("__d"))
    return digest.select("rows", F.sha2(F.concat_ws(":", F.lit(names), "__d"), 256).alias("digest"))


TREE_FAN = 1024


def ordered_digest(df: DataFrame, order: Sequence[str | Column], truncated: bool = False, fan: int = TREE_FAN) -> DataFrame:
    """Row count and digest of a frame in its row order: swapping two different rows changes it, partitioning does not.

    The digest is the root of a tree: each node hashes up to `fan` digests below it, in order, so no task sees more than
    that many at once. Rows are sorted by range in parallel (ties by content) and get their place from the number of rows in
    the ranges before theirs. Only digests are sorted and written, once, to the shared folder.
    """
    # Equal rows may fall in any order among themselves, and a number tells them apart, so that many of them share no range.
    marked = df.withColumns({"__digest": row_digest(df.columns), "__tie": F.monotonically_increasing_id()})
    placed = marked.orderBy(*order, "__digest", "__tie").select(F.col("__digest").alias("digest"), F.monotonically_increasing_id().alias("at"))
    staged = materialize(placed, "ordered-digest")
    # The number's upper bits are the range, its lower 33 bits the place within it.
    ranged = staged.select("digest", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))
    counts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("__all", F.lit(0))
    upto = running(counts, ["__all"], ["part"], F.floor(F.col("part") / 1000), F.col("n"), "upto").select("part", (F.col("upto") - F.col("n")).alias("before"))
    rows = staged.count()
    level = ranged.join(upto, "part").select((F.col("before") + F.col("place")).alias("at"), "digest")
    nodes = rows
    while nodes > 1 or (nodes == 1 and rows == 1):
        below = F.array_sort(F.collect_list(F.struct("at", "digest")))  # `fan` entries at most
        level = level.groupBy(F.floor(F.col("at") / fan).alias("up")).agg(F.sha2(F.array_join(F.transform(below, lambda x: x.digest), ""), 256).alias("digest"))
        level = level.withColumnRenamed("up", "at")
        if nodes == 1:
            break
        nodes = -(-nodes // fan)
    names = ",".join(df.columns) + ("|truncated" if truncated else "")
    root = level.agg(F.coalesce(F.max("digest"), F.lit("")).alias("root"))
    return root.select(F.lit(rows).cast("long").alias("rows"), F.sha2(F.concat_ws(":", F.lit(names), F.lit(str(rows)), "root"), 256).alias("digest"))


def project_outbox(outbox: DataFrame) -> DataFrame:
    """Management events as audit rows: always allowed, the event's own fields kept."""
    return outbox.select(
        "tenant_id", F.lit("allow").alias("decision"), "action", "actor_type", "actor_id", "details_json", "event_uuid",
        F.col("created_at").alias("ts"),
    )


def with_outbox(audit: DataFrame, outbox: DataFrame) -> DataFrame:
    return audit.unionByName(project_outbox(outbox), allowMissingColumns=True)


def bulk_merge(
    df: DataFrame, existing: DataFrame, key: Column, row: str, valid: Column, existing_key: str = "key"
) -> tuple[DataFrame, DataFrame]:
    """Split imported rows into ones to insert and ones refused with a reason.

    A key repeated inside the import counts once (its first row); a known key is refused, and so
    is a row that is not valid. `row` orders the import.
    """
    keyed = df.withColumn("__key", key)
    # The first row of each key comes from a map-side minimum, so a key that fills a third of the
    # import is never sorted in one place.
    first = keyed.filter(F.col("__key") != "").groupBy("__key").agg(F.min(row).alias("__first"))
    known = existing.select(F.col(existing_key).alias("__key")).distinct().withColumn("__known", F.lit(True))
    joined = keyed.join(first, "__key", "left").join(known, "__key", "left")
    reason = (
        F.when(F.col("__first").isNotNull() & (F.col(row) != F.col("__first")), "duplicate in file")
        .when(F.col("__known"), "already exists")
        .when(~F.coalesce(valid, F.lit(False)) | (F.col("__key") == ""), "invalid")
    )
    judged = joined.withColumn("reason", reason).drop("__first", "__known")
    return (
        judged.filter(F.col("reason").isNull()).drop("reason", "__key"),
        judged.filter(F.col("reason").isNotNull()).drop("__key"),
    )


def table_digests(tables: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Rows, content digest and key digest of each (frame, key columns), one aggregate per table."""
    out = None
    for name, (df, keys) in tables.items():
        text = _text_columns(df)
        columns = sorted(df.columns)
        one = text.agg(
            F.count(F.lit(1)).alias("rows"),
            set_digest(row_digest(columns)).alias("digest"),
            set_digest(row_digest(list(keys))).alias("key_digest"),
        ).select(F.lit(name).alias("table_name"), "rows", "digest", "key_digest")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no table given")
    return out


def compare_tables(src: Mapping[str, tuple[DataFrame, Sequence[str]]], dst: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Per table: do row counts, contents and keys agree on both sides?"""
    s = table_digests(src).select("table_name", F.struct("rows", "digest", "key_digest").alias("s"))
    d = table_digests(dst).select("table_name", F.struct("rows", "digest", "key_digest").alias("d"))
    return s.join(d, "table_name", "full_outer").select(
        "table_name",
        F.col("s.rows").alias("source_rows"),
        F.col("d.rows").alias("target_rows"),
        F.coalesce(F.col("s.digest") == F.col("d.digest"), F.lit(False)).alias("same_content"),
        F.coalesce(F.col("s.key_digest") == F.col("d.key_digest"), F.lit(False)).alias("same_keys"),
    )


def differing_rows(src: DataFrame, dst: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that are missing on a side or whose other columns differ."""
    columns = sorted(c for c in src.columns if c not in keys)
    side = lambda df, name: _text_columns(df).select(*keys, row_digest(columns).alias(name))
    joined = side(src, "s").join(side(dst, "d"), list(keys), "full_outer")
    kind = F.when(F.col("d").isNull(), "missing_in_target").when(F.col("s").isNull(), "missing_in_source").when(
        F.col("s") != F.col("d"), "different"
    )
    return joined.select(*keys, kind.alias("difference")).filter(F.col("difference").isNotNull())


def orphans(child: DataFrame, parent: DataFrame, reference: str, key: str) -> DataFrame:
    """Child rows whose reference names no parent; rows without a reference do not count."""
    named = child.filter(F.col(reference).isNotNull())
    return named.join(parent.select(F.col(key).alias(reference)).distinct(), reference, "left_anti")


def retain(
    events: DataFrame, now: dt.datetime, ttl: dt.timedelta, max_bytes: int, order: Sequence[str], size: Column, slice_unit: str = "hour"
) -> DataFrame:
    """Events young enough, then the newest ones whose sizes together fit the cap.

    `order` starts with the creation time. The running size is a sum over time slices and inside
    each slice, so the whole log is never sorted in one task.
    """
    cutoff = F.lit(now - ttl).cast(events.schema[order[0]].dataType)
    young = events.filter(F.col(order[0]) >= cutoff).withColumns({"__all": F.lit(1), "__size": size})
    total = young.agg(F.coalesce(F.sum("__size"), F.lit(0))).scalar()
    summed = running(young, ["__all"], order, time_slice(order[0], slice_unit), F.col("__size"), "__upto")
    from_here = total - F.col("__upto") + F.col("__size")
    return summed.filter(from_here <= max_bytes).drop("__all", "__size", "__upto")


def retain_cursors(cursors: DataFrame, events: DataFrame, keys: Sequence[str], now: dt.datetime, ttl: dt.timedelta) -> DataFrame:
    """Cursors that are recent or still have events."""
    cutoff = F.lit(now - ttl).cast(cursors.schema["updated_at"].dataType)
    old = cursors.filter(F.col("updated_at") < cutoff)
    return cursors.filter(F.col("updated_at") >= cutoff).unionByName(old.join(events.select(*keys).distinct(), list(keys), "left_semi"))
