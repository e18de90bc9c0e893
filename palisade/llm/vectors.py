"""Vectors as integers in packed blocks, exact distances between them, and joins with keys that hold many rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_ROWS = 8192
HOT_KEYS = 200
LARGEST = 2**63 - 1

# Adds columns of its own to a block: takes the integers (rows x components).
Extra = Callable[[np.ndarray], dict[str, bytes]]


def component_limit(dims: int) -> int:
    """Integers beyond this are cut to it, so that every squared distance fits 62 bits (64 components: 2^27)."""
    return int(2**30 / math.sqrt(max(dims, 1)))


def to_integers(column: pa.Array, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: which rows have that many components, all of them finite, and floor(scale * x) of these."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        values = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    ends = np.cumsum(np.maximum(lengths, 0))
    wrong = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    fine = (lengths > 0) & (wrong[ends] == wrong[ends - np.maximum(lengths, 0)])
    for dims in np.unique(lengths[fine]):
        rows = np.flatnonzero(fine & (lengths == dims))
        limit = component_limit(int(dims))
        cells = values[(ends[rows] - dims)[:, None] + np.arange(dims)]
        yield rows, np.clip(cells, -limit, limit).astype(np.int64)


def pack_integers(values: np.ndarray) -> tuple[int, bytes]:
    """Bytes of the narrowest kind that holds all values, and how many bytes each takes."""
    most = int(np.abs(values).max()) if values.size else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w - 1))
    return width, np.ascontiguousarray(values, dtype=f"<i{width}").tobytes()


def unpack_integers(data: bytes, width: int, dims: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{width}").reshape(-1, dims).astype(np.int64)


def vector_blocks(vectors: DataFrame, scale: int, carried: Sequence[str] = (), extra: Extra | None = None, extra_columns: Sequence[str] = ()) -> DataFrame:
    """One row for up to BLOCK_ROWS vectors of one length: n, dims, width, vec_id and carried columns as arrays, cells packed.

    Rows whose embedding is null, empty, or holds a null or non-finite component (after scaling) are left out.
    """
    kind = vectors.schema["embedding"].dataType.elementType
    embedding = F.col("embedding") if isinstance(kind, (T.FloatType, T.DoubleType)) else F.col("embedding").cast("array<double>")
    names = ["vec_id", *carried]
    chosen = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), *carried, embedding.alias("embedding"))
    fields = [T.StructField(c, T.IntegerType()) for c in ("n", "dims", "width")]
    fields += [T.StructField(c, T.ArrayType(chosen.schema[c].dataType)) for c in names]
    fields += [T.StructField(c, T.BinaryType()) for c in ("cells", *extra_columns)]

    def block(rows: pa.Table, cells: np.ndarray) -> pa.RecordBatch:
        width, data = pack_integers(cells)
        added = extra(cells) if extra is not None else {}
        columns = {"n": pa.array([len(cells)], pa.int32()), "dims": pa.array([cells.shape[1]], pa.int32()), "width": pa.array([width], pa.int32())}
        for c in names:
            values = rows[c].combine_chunks()
            values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
            columns[c] = pa.ListArray.from_arrays(pa.array([0, len(cells)], pa.int32()), values)
        columns["cells"] = pa.array([data], pa.binary())
        columns |= {c: pa.array([added.get(c)], pa.binary()) for c in extra_columns}
        return pa.RecordBatch.from_pydict(columns)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        n = 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for rows, cells in to_integers(batch.column("embedding"), scale):
                held.setdefault(cells.shape[1], []).append((table.select(names).take(pa.array(rows)), cells))
                n += len(rows)
            if n >= BLOCK_ROWS:
                yield from flush(held)
                held, n = {}, 0
        yield from flush(held)

    def flush(held: dict[int, list]) -> Iterator[pa.RecordBatch]:
        for parts in held.values():
            rows, cells = pa.concat_tables([t for t, _ in parts]), np.concatenate([c for _, c in parts])
            for at in range(0, len(cells), BLOCK_ROWS):
                yield block(rows.slice(at, BLOCK_ROWS), cells[at : at + BLOCK_ROWS])

    return chosen.mapInArrow(gather, T.StructType(fields))


def square_distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances, points x centres, of integers."""
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(centres).max(initial=0)))
    # Whole numbers below 2^53 are exact as floats too, and float products are much faster.
    kind = np.float64 if 4 * most * most * points.shape[1] < 2**53 else np.int64
    p, c = points.astype(kind), centres.astype(kind)
    return ((p * p).sum(axis=1)[:, None] - 2 * (p @ c.T) + (c * c).sum(axis=1)).astype(np.int64)


def sums_by(group: np.ndarray, values: np.ndarray, groups: int) -> np.ndarray:
    """Exact sums of the rows of each group."""
    out = np.zeros((groups, values.shape[1]), dtype=np.int64)
    order = np.argsort(group, kind="stable")
    present, starts = np.unique(group[order], return_index=True)
    if len(present):
        out[present] = np.add.reduceat(values[order], starts, axis=0)
    return out


def total_cells(blocks: DataFrame, column: str, cells: int) -> list[int]:
    """Sums over all blocks of a column of packed 64-bit integers, `cells` of them in each block.

    A task adds up its own blocks, so at most `cells` rows leave each task and reach the driver.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, dtype=np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                if data is not None:
                    total += np.frombuffer(data, "<i8")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "v"])

    rows = blocks.select(column).mapInArrow(add, "at int, v long").groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    out = [0] * cells
    for row in rows:
        out[row["at"]] = int(row["v"])
    return out


def smallest_rows(blocks: DataFrame, dims: int, k: int, order: Callable[[list], list]) -> list[list[int]]:
    """Vectors of the k rows that come first by order(vec_ids), a list of texts; ties by their components."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                names = order(row["vec_id"])
                cells = unpack_integers(row["cells"], row["width"], dims)
                last = sorted(names)[:k][-1]
                first = sorted((i for i, name in enumerate(names) if name <= last), key=lambda i: (names[i], cells[i].tolist()))[:k]
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in first], pa.string()), pa.array([cells[i].tolist() for i in first], pa.list_(pa.int64()))], ["name", "cells"])

    firsts = blocks.select("vec_id", "width", "cells").mapInArrow(least, "name string, cells array<bigint>")
    return [row["cells"] for row in firsts.orderBy("name", "cells").limit(k).collect()]


def attach(rows: DataFrame, table: DataFrame, keys: Sequence[str], n: str = "n") -> DataFrame:
    """`rows` with the columns of the one row that `table` has for their keys (null equals null), or nulls.

    `n` says how many rows a key has. Fewer than HOT_KEYS keys can have more than that share of all rows: these go to
    every task, and the others meet their rows in a shuffle, where none of them is large.
    """
    total = int(table.agg(F.sum(n)).first()[0] or 0)
    new = [c for c in table.columns if c not in keys and c != n]
    side = table.select(*[F.col(c).alias(f"__{c}") for c in keys], F.col(n).alias("__n"), *new)
    same = [rows[c].eqNullSafe(F.col(f"__{c}")) for c in keys]
    hot = F.broadcast(side.filter(F.col("__n") > total // HOT_KEYS))
    joined = rows.join(hot, same, "left")
    found = joined.filter(F.col("__n").isNotNull()).select(*[rows[c] for c in rows.columns], *new)
    left = joined.filter(F.col("__n").isNull()).select(*[rows[c] for c in rows.columns])
    others = side.filter(F.col("__n") <= total // HOT_KEYS)
    met = left.join(others, [left[c].eqNullSafe(F.col(f"__{c}")) for c in keys], "left")
    return found.unionByName(met.select(*[left[c] for c in rows.columns], *new))
