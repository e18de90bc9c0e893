"""Vector code compression: each part of a vector becomes the index of a codebook entry, learned by dual-tree Lloyd rounds.

A block keeps a tree over its vectors' parts for each part position, built once; a round builds a tree over the
entries. Pairs of a part node and an entry node are pruned by the distances between their boxes. A part node whose
only entry is left is assigned whole, by its cached sum and count; in leaves that stay uncertain the parts that are
left are compared with the entries that are left, in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.llm.vectors import LARGEST, attach, smallest_rows, total_cells, unpack_integers, vector_blocks
from palisade.session import materialize

LEAF = 16


def levels_of(n: int, leaf: int) -> int:
    """Depth at which nodes hold about `leaf` points, one at least."""
    return max(0, (max(n, 1) // leaf).bit_length() - 1)


def edges(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin, and n; a node's two children share its range."""
    return np.arange((1 << level) + 1, dtype=np.int64) * n >> level


def tree_order(points: np.ndarray, leaf: int) -> np.ndarray:
    """Points in the order of a tree that halves each node along its widest side."""
    n = len(points)
    order = np.arange(n)
    for level in range(levels_of(n, leaf)):
        bounds = edges(n, level)
        inside = points[order]
        low, high = np.minimum.reduceat(inside, bounds[:-1]), np.maximum.reduceat(inside, bounds[:-1])
        node = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        widest = np.argmax(high - low, axis=1)
        order = order[np.lexsort((inside[np.arange(n), widest[node]], node))]
    return order


@dataclass
class Tree:
    """Boxes and sums of the nodes of all levels over points in tree order."""

    points: np.ndarray
    depth: int
    low: list[np.ndarray]
    high: list[np.ndarray]
    sums: list[np.ndarray]

    @classmethod
    def over(cls, points: np.ndarray, leaf: int) -> Tree:
        depth = levels_of(len(points), leaf)
        starts = edges(len(points), depth)[:-1]
        low, high = [np.minimum.reduceat(points, starts)], [np.maximum.reduceat(points, starts)]
        sums = [np.add.reduceat(points, starts)]
        for _ in range(depth):
            low.append(np.minimum(low[-1][0::2], low[-1][1::2]))
            high.append(np.maximum(high[-1][0::2], high[-1][1::2]))
            sums.append(sums[-1][0::2] + sums[-1][1::2])
        return cls(points, depth, low[::-1], high[::-1], sums[::-1])


def _firsts(group: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, dtype=np.int64)


def _repeat(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Ranges starts[i] .. starts[i] + sizes[i] behind each other."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)


@dataclass
class Settled:
    """What a traversal found: the entry of each point in tree order, sums and counts of each entry, points compared."""

    code: np.ndarray
    sums: np.ndarray
    counts: np.ndarray
    compared: int


def assign(parts: Tree, entries: Tree, names: np.ndarray) -> Settled:
    """The nearest entry (ties: the smaller of its names, 0 to k-1) of all points of a tree."""
    n, k = len(parts.points), len(entries.points)
    out = Settled(np.zeros(n, dtype=np.int64), np.zeros((k, parts.points.shape[1]), dtype=np.int64), np.zeros(k, dtype=np.int64), 0)
    node = entry = np.zeros(1, dtype=np.int64)
    level = deep = 0
    alone = entries.depth == 0 and k == 1  # entry nodes are single entries
    while len(node):
        if alone:
            low, high = entries.points[entry], entries.points[entry]
        else:
            low, high = entries.low[deep][entry], entries.high[deep][entry]
        near, far = parts.low[level][node], parts.high[level][node]
        least = np.square(np.maximum(0, np.maximum(low - far, near - high))).sum(axis=1)
        most = np.square(np.maximum(high - near, far - low)).sum(axis=1)
        starts = _firsts(node)
        sizes = np.diff(np.r_[starts, len(node)])
        # Every point of a node has an entry as near as this; nodes farther away cannot hold the nearest, nor a tie.
        bound = np.repeat(np.minimum.reduceat(most, starts), sizes)
        keep = least <= bound
        if alone:
            best = np.flatnonzero(most == bound)
            best = np.repeat(entry[best[_firsts(node[best])]], sizes)
            keep &= ~_farther(entries.points[entry], entries.points[best], parts.low[level][node], parts.high[level][node])
        node, entry = node[keep], entry[keep]
        starts = _firsts(node)
        sizes = np.diff(np.r_[starts, len(node)])
        bounds = edges(n, level)
        if alone:
            one = starts[sizes == 1]
            whole, name = node[one], names[entry[one]]
            length = bounds[whole + 1] - bounds[whole]
            out.code[_repeat(bounds[whole], length)] = np.repeat(name, length)
            np.add.at(out.sums, name, parts.sums[level][whole])
            np.add.at(out.counts, name, length)
            several = np.repeat(sizes > 1, sizes)
            node, entry = node[several], entry[several]
            if level == parts.depth:
                _leaves(parts, entries, names, bounds, node, entry, out)
                break
        if level < parts.depth:
            # Both children of a node take over its entries, so pairs of one node stay together.
            starts = _firsts(node)
            sizes = np.diff(np.r_[starts, len(node)])
            entry = entry[_repeat(np.repeat(starts, 2), np.repeat(sizes, 2))]
            node = np.repeat(np.repeat(2 * node[starts], 2) + np.tile([0, 1], len(starts)), np.repeat(sizes, 2))
            level += 1
        if deep < entries.depth:
            node, entry = np.repeat(node, 2), (2 * np.repeat(entry, 2)) + np.tile([0, 1], len(entry))
            deep += 1
        elif not alone:
            within = edges(k, deep)
            sizes = within[entry + 1] - within[entry]
            node, entry, alone = np.repeat(node, sizes), _repeat(within[entry], sizes), True
    return out


def _farther(entry: np.ndarray, other: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether all points of a box are farther from the entry than from the other one: true if its nearest corner is."""
    corner = np.where(other > entry, low, high)
    return ((other - entry) * (other + entry - 2 * corner)).sum(axis=1) < 0


def _leaves(parts: Tree, entries: Tree, names: np.ndarray, bounds: np.ndarray, node: np.ndarray, entry: np.ndarray, out: Settled) -> None:
    """Compares the points of uncertain leaves with the entries that are left for them."""
    if len(node) == 0:
        return
    order = np.lexsort((names[entry], node))
    node, entry = node[order], entry[order]
    starts = _firsts(node)
    choices = np.diff(np.r_[starts, len(node)])
    leaf = node[starts]
    length = bounds[leaf + 1] - bounds[leaf]
    point = _repeat(bounds[leaf], length)
    each = np.repeat(choices, length)
    tried = entry[_repeat(np.repeat(starts, length), each)]
    squares = np.square(parts.points[np.repeat(point, each)] - entries.points[tried]).sum(axis=1)
    at = np.cumsum(each) - each
    # Entries are tried in the order of their names, so the first of the least is the smaller name.
    ties = np.flatnonzero(squares == np.repeat(np.minimum.reduceat(squares, at), each))
    owner = np.repeat(np.arange(len(point)), each)[ties]
    name = names[tried[ties[_firsts(owner)]]]
    out.code[point] = name
    np.add.at(out.sums, name, parts.points[point])
    np.add.at(out.counts, name, 1)
    out.compared += len(squares)


def _trees(cells: np.ndarray, order: bytes, positions: int) -> Iterator[tuple[slice, np.ndarray, Tree]]:
    """For each part position: its components, the tree order and the tree of a block."""
    n, width = len(cells), cells.shape[1] // positions
    orders = np.frombuffer(order, "<u2").reshape(positions, n).astype(np.int64)
    for p in range(positions):
        part = slice(p * width, (p + 1) * width)
        yield part, orders[p], Tree.over(cells[orders[p], part], LEAF)


def _order_bytes(positions: int):
    def build(cells: np.ndarray) -> dict[str, bytes]:
        dims = cells.shape[1]
        if dims % positions:
            return {}
        width = dims // positions
        return {"order": np.concatenate([tree_order(cells[:, p * width : (p + 1) * width], LEAF) for p in range(positions)]).astype("<u2").tobytes()}

    return build


def _entry_trees(codebooks: np.ndarray) -> list[tuple[Tree, np.ndarray]]:
    """A tree over the entries of each part position, and their names in tree order; none where there are no entries."""
    out = []
    for book in codebooks if codebooks.shape[1] else ():
        names = tree_order(book, 1)
        out.append((Tree.over(book[names], 1), names))
    return out


def _sums(blocks: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """Sums and counts of the parts of each entry, positions x entries x (components, count)."""
    positions, k, width = codebooks.shape

    def assign_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = _entry_trees(codebooks)
        total = np.zeros((positions, k, width + 1), dtype=np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                cells = unpack_integers(row["cells"], row["width"], positions * width)
                for p, (_, _, tree) in enumerate(_trees(cells, row["order"], positions)):
                    done = assign(tree, *books[p])
                    total[p] += np.hstack([done.sums, done.counts[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    summed = blocks.select("cells", "width", "order").mapInArrow(assign_parts, "total binary")
    return np.array(total_cells(summed, "total", positions * k * (width + 1)), dtype=object).reshape(positions, k, width + 1)


def _coded(blocks: DataFrame, codebooks: np.ndarray, label: T.DataType) -> DataFrame:
    positions, k, width = codebooks.shape

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = _entry_trees(codebooks)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                cells = unpack_integers(row["cells"][0].as_py(), row["width"][0].as_py(), positions * width)
                codes = np.empty((len(cells), positions), dtype=np.uint8)
                error = np.zeros(len(cells), dtype=np.int64)
                for p, (part, order, tree) in enumerate(_trees(cells, row["order"][0].as_py(), positions)):
                    codes[order, p] = assign(tree, *books[p]).code
                    error += np.square(cells[:, part] - codebooks[p][codes[:, p]]).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [row["vec_id"].flatten(), row["label"].flatten(), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)],
                    ["vec_id", "label", "code", "error"],
                )

    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", label), T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])
    return blocks.select("vec_id", "label", "cells", "width", "order").mapInArrow(code, schema)


def compress(vectors: DataFrame, positions: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, np.ndarray]:
    """Codes (vec_id, label, code as one byte for each position, error) and codebooks (positions x entries x components).

    Rows whose vector is null, empty, or holds a null or non-finite component are left out; the others become
    integers floor(scale * x). All vectors of a table have the commonest length that can be cut into `positions` equal
    parts (ties: the longest); rows of another length cannot be coded and are left out. Codebooks start from the vectors
    with the smallest vec_ids (null last, rows that share an id in order of their components), and hold as many
    entries as there are vectors where these are fewer. Every row is a vector of its own, repeated ones too; label may
    be null or absent, and other columns are left out. An integer beyond 2^27 (64 components) is cut to it. At most
    256 entries. No vectors: an empty table, and codebooks without entries.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte, so 1 to 256 entries")
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int").alias("label")
    chosen = vectors.select("vec_id", "embedding", label)
    blocks = materialize(vector_blocks(chosen, scale, ["label"], _order_bytes(positions), ["order"]), "codebooks-blocks")
    sizes = blocks.filter(F.col("order").isNotNull()).groupBy("dims").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    dims = sizes["dims"] if sizes else positions
    blocks = blocks.filter(F.col("dims") == dims)
    # 20 digits and a sign as text, so that ids of either sign come in order; a null comes last.
    ordered = lambda ids: ["~" if i is None else f"{i + 2**63:020d}" for i in ids]
    starts = np.array(smallest_rows(blocks, dims, entries, ordered), dtype=np.int64).reshape(-1, positions, dims // positions)
    codebooks = np.ascontiguousarray(starts.transpose(1, 0, 2))
    for _ in range(rounds if len(starts) else 0):
        sums = _sums(blocks, codebooks)
        for p, e in zip(*np.nonzero(sums[:, :, -1])):
            codebooks[p, e] = [s // sums[p, e, -1] for s in sums[p, e, :-1]]
    kind = chosen.schema["label"].dataType
    return materialize(_coded(blocks, codebooks, kind), "codebooks-codes"), codebooks


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Code and error of every vector, the error summed over its label, and a digest of all codebooks."""
    coded, codebooks = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest = hashlib.sha256(",".join(map(str, codebooks.reshape(-1).tolist())).encode()).hexdigest()
    summed = F.sum(F.col("error").cast("decimal(38,0)"))
    labels = coded.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.least(summed, F.lit(LARGEST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    out = attach(coded, labels, ["label"])
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
