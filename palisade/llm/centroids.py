"""Centroid clustering: Lloyd's rounds where each cluster keeps its vectors in a heap ordered by what is left of their bounds.

A vector's gap is its distance to the second nearest centroid less that to its own. Each move of centroids can
close it by no more than its own centroid's move and the largest move of the others, so a cluster adds these to one
drift, and a vector stays where it is as long as the gap it had, plus the drift of that time, exceeds the drift
now. Only vectors at the top of a heap, whose gap has run out, are popped and compared with all centroids again.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.vectors import LARGEST, square_distances, sums_by, total_cells, smallest_rows, unpack_integers, vector_blocks
from palisade.session import materialize

# Square roots and sums of drifts are rounded; bounds give way by a share and a constant, so a vector is rather
# compared once too often.
SLACK, LEAST_GAP = 1e-9, 1e-6
_STATE = "n int, width int, vec_id array<bigint>, cells binary, keys binary, rows binary, ends binary, change binary, popped long"


@dataclass
class Heaps:
    """Heaps of all clusters in one block: sorted runs, and a sorted run is a heap. Cluster c holds ends[c]:ends[c+1]."""

    keys: np.ndarray  # gap when the vector was pushed, plus its cluster's drift of that time
    rows: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, cluster: np.ndarray, keys: np.ndarray, rows: np.ndarray, clusters: int) -> Heaps:
        order = np.lexsort((rows, keys, cluster))
        return cls(keys[order], rows[order], np.searchsorted(cluster[order], np.arange(clusters + 1)))

    def clusters(self) -> np.ndarray:
        """The cluster of each entry."""
        return np.repeat(np.arange(len(self.ends) - 1), np.diff(self.ends))

    def expired(self, drift: np.ndarray) -> np.ndarray:
        """Flags of the entries that have to be popped: the top of each heap up to its drift."""
        out = np.zeros(len(self.keys), dtype=bool)
        for c, (lo, hi) in enumerate(zip(self.ends[:-1], self.ends[1:])):
            out[lo : lo + np.searchsorted(self.keys[lo:hi], drift[c], side="right")] = True
        return out


def scan(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each point (ties: the smaller number), and the gap to the second nearest."""
    squares = square_distances(points, centres)
    best = np.argmin(squares, axis=1)
    at = np.arange(len(points))
    upper = np.sqrt(squares[at, best].astype(np.float64))
    if len(centres) == 1:
        return best, np.full(len(points), np.inf)
    squares[at, best] = LARGEST
    lower = np.sqrt(squares.min(axis=1).astype(np.float64))
    return best, lower - upper - SLACK * (lower + upper) - LEAST_GAP


def step(points: np.ndarray, heaps: Heaps | None, centres: np.ndarray, drift: np.ndarray) -> tuple[Heaps, np.ndarray, int]:
    """Heaps after the expired vectors found their nearest centroid, the change of sums and counts, vectors popped."""
    k, dims = centres.shape
    if heaps is None:
        rows, before = np.arange(len(points)), None
        stay = Heaps(np.zeros(0), np.zeros(0, dtype=np.int64), np.zeros(k + 1, dtype=np.int64))
    else:
        gone, cluster = heaps.expired(drift), heaps.clusters()
        rows, before = heaps.rows[gone], cluster[gone]
        ends = np.searchsorted(cluster[~gone], np.arange(k + 1))
        stay = Heaps(heaps.keys[~gone], heaps.rows[~gone], ends)
    best, gap = scan(points[rows], centres) if len(rows) else (rows, np.zeros(0))
    pushed = Heaps.of(np.concatenate([stay.clusters(), best]), np.concatenate([stay.keys, gap + drift[best]]), np.concatenate([stay.rows, rows]), k)
    counted = np.hstack([points[rows], np.ones((len(rows), 1), dtype=np.int64)])
    moved = np.ones(len(rows), dtype=bool) if before is None else best != before
    change = sums_by(best[moved], counted[moved], k)
    if before is not None:
        change -= sums_by(before[moved], counted[moved], k)
    return pushed, change, len(rows)


def _round(blocks: DataFrame, centres: list[list[int]], drift: list[float], dims: int, first: bool) -> DataFrame:
    k = len(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, moved = np.array(centres, dtype=np.int64).reshape(k, dims), np.array(drift)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                points = unpack_integers(row["cells"][0].as_py(), row["width"][0].as_py(), dims)
                heaps = None
                if not first:
                    kinds = (("keys", "<f8"), ("rows", "<i4"), ("ends", "<i4"))
                    keys, rows, ends = (np.frombuffer(row[c][0].as_py(), kind) for c, kind in kinds)
                    heaps = Heaps(keys, rows.astype(np.int64), ends.astype(np.int64))
                heaps, change, popped = step(points, heaps, to, moved)
                packed = [heaps.keys.astype("<f8"), heaps.rows.astype("<i4"), heaps.ends.astype("<i4"), change.astype("<i8")]
                columns = [row[c] for c in ("n", "width", "vec_id", "cells")] + [pa.array([a.tobytes()], pa.binary()) for a in packed]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([popped], pa.int64())], [c.split()[0] for c in _STATE.split(", ")])

    return materialize(blocks.mapInArrow(assign, _STATE), "centroids-state")


def _distances(state: DataFrame, centres: list[list[int]], dims: int) -> DataFrame:
    """vec_id, cluster and distance of every vector."""
    k = len(centres)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = np.array(centres, dtype=np.int64).reshape(k, dims)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                points = unpack_integers(row["cells"][0].as_py(), row["width"][0].as_py(), dims)
                rows, ends = (np.frombuffer(row[c][0].as_py(), "<i4") for c in ("rows", "ends"))
                cluster = np.empty(len(points), dtype=np.int32)
                cluster[rows] = np.repeat(np.arange(k), np.diff(ends))
                apart = points - to[cluster]
                yield pa.RecordBatch.from_arrays([row["vec_id"].flatten(), pa.array(cluster), pa.array((apart * apart).sum(axis=1))], ["vec_id", "cluster", "distance"])

    return state.mapInArrow(measure, "vec_id long, cluster int, distance long")


def centroid_clusters(vectors: DataFrame, clusters: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: str = "1") -> tuple[DataFrame, DataFrame]:
    """Members (vec_id, cluster, distance) and centroids (cluster, centroid, members, cluster_inertia, inertia, popped).

    Vectors with exactly `dims` components, none null or non-finite, become integers floor(scale * x); others are
    left out. The first centroids are the vectors with the smallest sha256 of '<seed>:<vec_id>' (a null id is an
    empty text; rows that share an id come in order of their components), fewer where there are fewer vectors. Every
    row is a vector of its own, repeated ones too, and other columns are left out. An integer beyond 2^27 is cut to
    it, a distance sum beyond a long to the largest long. `popped` is, for each assignment, how many vectors were
    compared with all centroids. No vectors: two empty tables.
    """
    spark = vectors.sparkSession
    blocks = materialize(vector_blocks(vectors.select("vec_id", "embedding"), scale).filter(F.col("dims") == dims), "centroids-blocks")
    hashed = lambda ids: [hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest() for i in ids]
    centres = smallest_rows(blocks, dims, clusters, hashed)
    k = len(centres)
    drift, totals, popped = [0.0] * k, [[0] * (dims + 1) for _ in range(k)], []
    state = blocks
    for number in range(rounds + 1):
        state = _round(state, centres, drift, dims, number == 0)
        popped.append(int(state.agg(F.sum("popped")).first()[0] or 0))
        if number == rounds:
            break
        change = total_cells(state, "change", k * (dims + 1))
        moves = []
        for c in range(k):
            totals[c] = [a + b for a, b in zip(totals[c], change[c * (dims + 1) :])]
            *sums, n = totals[c]
            new = [s // n for s in sums] if n else centres[c]
            moves.append(math.sqrt(sum((a - b) ** 2 for a, b in zip(new, centres[c]))) * (1 + SLACK))
            centres[c] = new
        for c in range(k):
            drift[c] += moves[c] + max((m for other, m in enumerate(moves) if other != c), default=0.0)
    members = materialize(_distances(state, centres, dims), "centroids-members")
    sums = {r["cluster"]: r for r in members.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"), F.count(F.lit(1)).alias("n")).collect()}
    inertia = min(LARGEST, sum(int(r["d"]) for r in sums.values()))
    found = [(c, centres[c], sums[c]["n"] if c in sums else 0, min(LARGEST, int(sums[c]["d"])) if c in sums else 0, inertia, popped) for c in range(k)]
    schema = "cluster int, centroid array<bigint>, members long, cluster_inertia long, inertia long, popped array<bigint>"
    return members, spark.createDataFrame(found, schema)


def op11_centroid_clusters(spark, sf_dir: str) -> DataFrame:
    """Cluster of every vector, its squared distance, the clusters' inertia and a digest of its centroid."""
    members, centroids = centroid_clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest = F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ","), 256)
    # One row for each of at most 16 clusters.
    side = F.broadcast(centroids.select("cluster", "cluster_inertia", "inertia", digest.alias("centroid_sha256")))
    return members.join(side, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
