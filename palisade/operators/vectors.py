"""Exact top-k by dot product or cosine over any number of candidates.

Queries are handed to all tasks in slices of bounded size; each task scans its own candidates once for a
slice and keeps k per query. Candidates are never shuffled or paired with queries in a table, and a task's
product of queries and candidates has bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Queries that one scan answers, and candidates and queries that meet in one product.
QUERIES_PER_SCAN = 16_384
QUERIES_PER_PRODUCT, CANDIDATES_PER_PRODUCT = 1024, 4096
_DIGITS = 12  # scores are compared at 12 decimals, so equal vectors tie wherever they are computed

SCHEMA = T.StructType(
    [T.StructField("query_id", T.LongType()), T.StructField("candidate_id", T.LongType()), T.StructField("score", T.DoubleType())]
)


def _unit(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norms = np.sqrt((matrix * matrix).sum(axis=1))
    ok = np.isfinite(norms) & (norms > 0)
    return matrix / np.where(ok, norms, 1.0)[:, None], ok


class _Best:
    """The best k candidates of each query so far, ties to the smaller id."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int, threshold: float | None):
        self.query_ids, self.queries, self.k, self.threshold = query_ids, queries, k, threshold
        self.row, self.id, self.score = (np.zeros(0, t) for t in (np.int64, np.int64, np.float64))

    def offer(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        scores = np.round(self.queries @ vectors.T, _DIGITS)
        if scores.shape[1] > self.k:
            # Only what reaches the query's k-th best of this product can be among its best.
            least = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k]
            kept = scores >= least[:, None]
        else:
            kept = np.ones(scores.shape, dtype=bool)
        if self.threshold is not None:
            kept &= scores > self.threshold
        row, column = np.nonzero(kept)
        row = np.concatenate([self.row, row])
        found, score = np.concatenate([self.id, ids[column]]), np.concatenate([self.score, scores[kept]])
        order = np.lexsort((found, -score, row))
        row = row[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        order = order[rank < self.k]
        self.row, self.id, self.score = row[rank < self.k], found[order], score[order]

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame({"query_id": self.query_ids[self.row], "candidate_id": self.id, "score": self.score})


def _usable(ids: np.ndarray, vectors: np.ndarray, cosine: bool) -> tuple[np.ndarray, np.ndarray]:
    if cosine:
        vectors, ok = _unit(vectors)
    else:
        ok = np.isfinite(vectors).all(axis=1)
    return ids[ok], vectors[ok]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def top_k(
    candidates: DataFrame,
    queries: DataFrame,
    k: int,
    threshold: float | None = None,
    cosine: bool = True,
    queries_per_scan: int = QUERIES_PER_SCAN,
) -> DataFrame:
    """`candidates` and `queries` hold (id, vector); the result adds a rank, ties to the smaller id.

    Zero and non-finite vectors take no part. Each `queries_per_scan` queries cost one scan of the candidates.
    """
    q = queries.select(F.col("id").cast("bigint").alias("id"), "vector")
    c = candidates.select(F.col("id").cast("bigint").alias("id"), "vector")
    scans = max(1, -(-q.count() // queries_per_scan))
    local = None
    for scan in range(scans):
        slice_ = q.filter(F.pmod(F.xxhash64("id"), F.lit(scans)) == scan).toPandas()
        found = c.mapInPandas(_scan(slice_, k, threshold, cosine), SCHEMA)
        local = found if local is None else local.unionByName(found)
    return ranked(local, k)


def _scan(asked: pd.DataFrame, k: int, threshold: float | None, cosine: bool):
    query_ids, matrix = (asked["id"].to_numpy(), _matrix(asked["vector"])) if len(asked) else (np.zeros(0, np.int64), np.zeros((0, 0)))
    if len(asked):
        query_ids, matrix = _usable(query_ids, matrix, cosine)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [slice(i, i + QUERIES_PER_PRODUCT) for i in range(0, len(query_ids), QUERIES_PER_PRODUCT)]
        best = [_Best(query_ids[x], matrix[x], k, threshold) for x in parts]
        for batch in batches:
            if len(batch) == 0:
                continue
            ids, vectors = _usable(batch["id"].to_numpy(), _matrix(batch["vector"]), cosine)
            for i in range(0, len(ids), CANDIDATES_PER_PRODUCT):
                for x in best:
                    x.offer(ids[i : i + CANDIDATES_PER_PRODUCT], vectors[i : i + CANDIDATES_PER_PRODUCT])
        for x in best:
            yield x.frame()

    return scan


def ranked(local: DataFrame, k: int) -> DataFrame:
    """Merge per-task winners: at most k per task and query reach this window."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "candidate_id")
    return local.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


MAX_FILTERS, MAX_HITS = 4, 20


def vector_search(
    df: DataFrame, vector: list[float], equals: dict[str, object], tenant_id: str, k: int, id_col: str = "id", vector_col: str = "vector"
) -> DataFrame:
    """Cosine search inside one tenant and up to four equality filters, all applied before scoring."""
    if not tenant_id:
        raise ValueError("a tenant id is required")
    if len(equals) > MAX_FILTERS or not 1 <= k <= MAX_HITS:
        raise ValueError("at most 4 filters and 20 hits")
    kept = df.filter(F.col("tenant_id") == tenant_id)
    for name in sorted(equals):
        kept = kept.filter(F.col(name) == F.lit(equals[name]))
    query = df.sparkSession.createDataFrame([(0, [float(x) for x in vector])], "id bigint, vector array<double>")
    return top_k(kept.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")), query, k).drop("query_id")


def hybrid_rank(scored: DataFrame, alpha: float, k: int, keyword_enabled: bool = True) -> DataFrame:
    """Rank tables per question: exact names, then explicit mentions, then the mixed score, ties by index.

    `scored`: question_id, table_id, index, vector, keyword, explicit. Explicit tables stay beyond k.
    """
    mixed = F.col("vector") * alpha + F.col("keyword") * (1 - alpha) if keyword_enabled else F.col("vector")
    exact = (F.col("keyword") == 1.0).cast("int") if keyword_enabled else F.lit(0)
    order = Window.partitionBy("question_id").orderBy(
        exact.desc(), F.col("explicit").cast("int").desc(), mixed.desc(), F.col("index")
    )
    numbered = scored.withColumn("rank", F.row_number().over(order))
    return numbered.filter((F.col("rank") <= k) | F.col("explicit"))


def squared_norm(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
