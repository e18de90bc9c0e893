"""Ordered per-key folds for work that truly depends on the row before it.

Spark partitions and sorts the rows; a task then passes over them in Arrow batches and keeps
only a small state per key, so no key is ever held in memory as a whole. A key that is too long
for one task (checked by an aggregate) is cut into blocks of bounded size: block n of all keys
runs together before block n+1 and hands its states over through the shared folder, so a lost
executor costs at most one block. Every block costs a job, so a long key gets larger blocks rather than more of them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.functions.segments import join_same, row_numbers
from palisade.session import scratch_path

# Takes some consecutive rows of one key and the state before them; returns output and new state.
Step = Callable[[pd.DataFrame, dict | None], tuple[pd.DataFrame, dict]]

MAX_BLOCK_ROWS = 20_000_000
# Blocks of a key as long as each stays within MAX_BLOCK_ROWS.
MAX_BLOCKS = 8
_STATE = "__state"


def _pass(step: Step, keys: list[str], columns: list[str], keep_state: bool):
    def closing(key: tuple, state: dict) -> pd.DataFrame:
        row = {**dict.fromkeys(columns), **dict(zip(keys, key)), _STATE: json.dumps(state)}
        return pd.DataFrame([row], dtype=object)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            done = []
            # Rows arrive sorted by key, so each group is one run of consecutive rows.
            for _, rows in batch.groupby(keys, sort=False, dropna=False):
                here = tuple(None if pd.isna(v) else v for v in rows[keys].iloc[0])
                if here != key:
                    if keep_state and key is not None:
                        done.append(closing(key, state))
                    carried = rows[_STATE].iloc[0] if keep_state else None
                    key, state = here, json.loads(carried) if isinstance(carried, str) else None
                out, state = step(rows, state)
                out = out[columns]
                done.append(out.assign(**{_STATE: None}).astype(object) if keep_state else out)
            if done:
                yield pd.concat(done, ignore_index=True)
        if keep_state and key is not None:
            yield closing(key, state)

    return run


def _sorted(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order)


def ordered_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slice_col: Column,
    step: Step,
    output: T.StructType,
    max_block_rows: int = MAX_BLOCK_ROWS,
) -> DataFrame:
    """Fold each key's rows in `order`. `output` must contain the keys; `slice_col` must follow `order`.

    A key of more than `max_block_rows` rows is folded in blocks (see block_rows).
    """
    keys, order, columns = list(keys), list(order), output.fieldNames()
    longest = _longest(df, keys)
    if longest <= max_block_rows:
        return _sorted(df, keys, order).mapInPandas(_pass(step, keys, columns, False), output)
    folded, schema = _in_blocks(df, keys, order, slice_col, step, output, block_rows(longest, max_block_rows))
    return df.sparkSession.read.schema(schema).parquet(*folded).filter(F.col(_STATE).isNull()).drop(_STATE)


def ordered_states(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slice_col: Column,
    step: Step,
    output: T.StructType,
    max_block_rows: int = MAX_BLOCK_ROWS,
) -> DataFrame:
    """The keys and the state of each after the same fold, as JSON text in `state`: where a stream can carry on."""
    keys, order = list(keys), list(order)
    longest = _longest(df, keys)
    if longest <= max_block_rows:
        schema = T.StructType([*output.fields, T.StructField(_STATE, T.StringType())])
        rows = _sorted(df, keys, order).withColumn(_STATE, F.lit(None).cast("string"))
        done = rows.mapInPandas(_pass(step, keys, output.fieldNames(), True), schema)
        return done.filter(F.col(_STATE).isNotNull()).select(*keys, F.col(_STATE).alias("state"))
    folded, schema = _in_blocks(df, keys, order, slice_col, step, output, block_rows(longest, max_block_rows))
    spark, found = df.sparkSession, None
    for number, path in enumerate(folded):
        here = spark.read.schema(schema).parquet(path).filter(F.col(_STATE).isNotNull()).select(*keys, F.lit(number).alias("__block"), _STATE)
        found = here if found is None else found.unionByName(here)
    return found.groupBy(*keys).agg(F.max_by(_STATE, "__block").alias("state"))


def block_rows(longest: int, asked: int) -> int:
    """Rows of a block: as asked, or more where that would make over MAX_BLOCKS blocks, but then never over MAX_BLOCK_ROWS."""
    return max(asked, min(MAX_BLOCK_ROWS, -(-longest // MAX_BLOCKS)))


def _longest(df: DataFrame, keys: list[str]) -> int:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def _in_blocks(
    df: DataFrame, keys: list[str], order: list[str], slice_col: Column, step: Step, output: T.StructType, max_block_rows: int
) -> tuple[list[str], T.StructType]:
    """Folders with the output and the states of each block of all keys, one after the other, and their schema."""
    spark = df.sparkSession
    schema = T.StructType([*output.fields, T.StructField(_STATE, T.StringType())])
    staged = scratch_path(spark, "fold-input")
    numbered = row_numbers(df, keys, order, slice_col, "__n").withColumn("__block", F.floor((F.col("__n") - 1) / max_block_rows).cast("int"))
    numbered.drop("__n").write.partitionBy("__block").parquet(staged)
    blocks = 1 + spark.read.schema("__block int").parquet(staged).agg(F.max("__block")).first()[0]
    result = scratch_path(spark, "fold-output")
    paths, carried = [], None
    for block in range(blocks):
        rows = spark.read.schema(df.schema).parquet(f"{staged}/__block={block}")
        if carried is None:
            rows = rows.withColumn(_STATE, F.lit(None).cast("string"))
        else:
            rows = join_same(rows, carried, keys, "left")
        paths.append(f"{result}/block={block}")
        _sorted(rows, keys, order).mapInPandas(_pass(step, keys, output.fieldNames(), True), schema).write.parquet(paths[-1])
        carried = spark.read.schema(schema).parquet(paths[-1]).filter(F.col(_STATE).isNotNull()).select(*keys, _STATE)
    return paths, schema
