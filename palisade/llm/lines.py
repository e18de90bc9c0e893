"""Line deduplication against a levelled index of line hashes that grows batch by batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.llm.blocks import Answers, block_count, block_key, bucket_bits, bucket_bounds, ids_of, in_order, send, settle
from palisade.llm.runtime import hide_columns
from palisade.llm.spans import LOWER, SPACE, flat, hash_spans, pack, unpack
from palisade.session import scratch_path

LEAST_CHARS = 10
BATCHES = 4
FANOUT = 2
_RUN = "bucket int, data binary"


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (without the line break) of all lines, and lines before each text; every text has one at least."""
    breaks = np.flatnonzero(data == 0x0A)
    before = np.searchsorted(breaks, offsets)
    n = len(offsets) - 1
    counts = np.diff(before) + 1
    bounds = np.concatenate([[0], np.cumsum(counts)])
    starts = np.empty(bounds[-1], dtype=np.int64)
    ends = np.empty(bounds[-1], dtype=np.int64)
    first = np.zeros(bounds[-1], dtype=bool)
    first[bounds[:-1]] = True
    last = np.zeros(bounds[-1], dtype=bool)
    last[bounds[1:] - 1] = True
    starts[first], starts[~first] = offsets[:n], breaks + 1
    ends[last], ends[~last] = offsets[1:], breaks
    return starts, ends, bounds


class Keys:
    """The keys of a block's lines: stripped, A-Z lower-cased, and hashed where they are long enough."""

    def __init__(self, docs: pa.Table, least_chars: int):
        self.data, self.offsets = flat(docs["text"])
        self.starts, self.ends, self.bounds = line_spans(self.data, self.offsets)
        full = np.flatnonzero(~SPACE[self.data])
        lo = np.searchsorted(full, self.starts)
        hi = np.searchsorted(full, self.ends)
        some = hi > lo
        begin = full[lo[some]] if len(full) else lo[some]
        stop = full[hi[some] - 1] + 1 if len(full) else hi[some]
        chars = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])
        long = chars[stop] - chars[begin] >= least_chars
        line = np.flatnonzero(some)[long]
        lower = LOWER[self.data]
        a = hash_spans(lower, begin[long], stop[long])
        b = hash_spans(lower, begin[long], stop[long], 1).astype(np.uint32)
        doc = np.searchsorted(self.bounds, line, side="right") - 1
        # By key, then document: the first of each key is in the block's smallest document that holds it.
        order = np.lexsort((line, b, a))
        self.a, self.b, self.line, self.doc = a[order], b[order], line[order], doc[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (self.a[1:] != self.a[:-1]) | (self.b[1:] != self.b[:-1])
        self.first, self.rank = np.flatnonzero(new), np.cumsum(new) - 1


def _merge(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    a = np.concatenate([r[0] for r in runs]) if runs else np.zeros(0, np.uint64)
    b = np.concatenate([r[1] for r in runs]) if runs else np.zeros(0, np.uint32)
    order = np.lexsort((b, a))
    return a[order], b[order]


def _read(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    return tuple(unpack(data, np.uint64, np.uint32))


def _held(run: tuple[np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which sorted distinct keys a sorted run holds; equal first halves are rare, so their ranges are short."""
    lo, hi = np.searchsorted(run[0], a), np.searchsorted(run[0], a, side="right")
    found = np.zeros(len(a), dtype=bool)
    single = hi - lo == 1
    found[single] = run[1][lo[single]] == b[single]
    for i in np.flatnonzero(hi - lo > 1):
        found[i] = bool((run[1][lo[i] : hi[i]] == b[i]).any())
    return found


class LineIndex:
    """Keys seen so far, as sorted runs on levels: `fanout` runs of one level are compacted into one of the next.

    A run is a table in the shared folder, one row for each bucket of the key space with the sorted keys in it.
    """

    def __init__(self, spark: SparkSession, bits: int, fanout: int = FANOUT):
        self.spark, self.bits, self.fanout = spark, bits, fanout
        self.levels: list[list[str]] = [[]]

    def _runs(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], _RUN)
        return self.spark.read.schema(_RUN).parquet(*paths)

    def add(self, messages: DataFrame) -> DataFrame:
        """Merge one batch of messages (bucket, block, data) with all runs; returns its answers (bucket, block, data).

        An answer flags the keys that an earlier batch or a smaller document of this batch holds. The keys that
        no run holds become a new run of level 0.
        """

        def merge(rows: pa.Table, held: pa.Table) -> pa.Table:
            kept = {"bucket": [], "block": [], "data": []}
            if rows.num_rows:
                bucket = rows["bucket"][0].as_py()
                parts = [unpack(d.as_py(), np.uint64, np.uint32, np.int64) for d in rows["data"]]
                sizes = np.cumsum([0, *(len(p[0]) for p in parts)])
                a, b, ids = (np.concatenate(x) for x in zip(*parts))
                order = np.lexsort((ids, b, a))
                sa, sb, si = a[order], b[order], ids[order]
                new = np.ones(len(sa), dtype=bool)
                new[1:] = (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])
                first = np.flatnonzero(new)
                ka, kb = sa[first], sb[first]
                known = np.zeros(len(ka), dtype=bool)
                for data in held["data"]:
                    known |= _held(_read(data.as_py()), ka, kb)
                rank = np.cumsum(new) - 1
                later = np.empty(len(sa), dtype=bool)
                later[order] = known[rank] | (si > si[first][rank])
                for block, lo, hi in zip(rows["block"].to_pylist(), sizes[:-1], sizes[1:]):
                    kept["bucket"].append(bucket)
                    kept["block"].append(block)
                    kept["data"].append(np.packbits(later[lo:hi]).tobytes())
                if not known.all():
                    kept["bucket"].append(bucket)
                    kept["block"].append(-1)
                    kept["data"].append(pack(ka[~known], kb[~known]))
            return pa.table([pa.array(kept["bucket"], pa.int32()), pa.array(kept["block"], pa.int32()), pa.array(kept["data"], pa.binary())], names=list(kept))

        runs = self._runs([p for level in self.levels for p in level])
        path = scratch_path(self.spark, "lines-batch")
        schema = "bucket int, block int, data binary"
        merged = messages.groupBy("bucket").cogroup(runs.groupBy("bucket")).applyInArrow(merge, schema)
        merged.withColumn("kind", F.when(F.col("block") < 0, "run").otherwise("answer")).write.partitionBy("kind").parquet(path)
        done = self.spark.read.schema(schema + ", kind string").parquet(path)
        if not done.filter("kind = 'run'").isEmpty():
            self.levels[0].append(f"{path}/kind=run")
            self._compact()
        return done.filter("kind = 'answer'").drop("kind")

    def _compact(self) -> None:
        def merge(rows: pa.Table) -> pa.Table:
            a, b = _merge([_read(d.as_py()) for d in rows["data"]])
            return pa.table([rows["bucket"].slice(0, 1), pa.array([pack(a, b)], pa.binary())], names=["bucket", "data"])

        level = 0
        while len(self.levels[level]) >= self.fanout:
            path = scratch_path(self.spark, "lines-run")
            self._runs(self.levels[level]).groupBy("bucket").applyInArrow(merge, _RUN).write.parquet(path)
            self.levels[level] = []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(path)
            level += 1


def remove_repeated_lines(
    docs: DataFrame, least_chars: int = LEAST_CHARS, batches: int = BATCHES, blocks: int | None = None, fanout: int = FANOUT
) -> DataFrame:
    """Remove every line whose key a document with a smaller id holds too.

    A text is split at line breaks; a key is a line without spaces and tabs at its ends, A-Z lower-cased; only
    keys of `least_chars` code points or more count. Documents are taken in `batches` by id, each merged
    against the index of all before it. Returns all columns of `docs` (doc_id, text and others) and n_lines, n_dropped
    and kept_text, one row for each row; columns of `docs` with these names are replaced. A null or empty text is
    one empty line (kept_text is then empty); a null id counts as the largest, and rows that share an id keep
    each other's lines.
    """
    docs, back = hide_columns(docs.drop("n_lines", "n_dropped", "kept_text"), "__block")
    spark = docs.sparkSession
    blocks = blocks or block_count(docs)
    bits = bucket_bits(blocks)
    marks = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [i / batches for i in range(1, batches)], 10_000)).first()[0] if batches > 1 else None
    batch = sum((F.coalesce(F.col("doc_id").cast("long") > F.lit(m), F.lit(True)).cast("int") for m in marks or []), F.lit(0))
    # A block holds documents of one batch.
    dealt = docs.withColumn("__block", (batch * F.lit(blocks) + block_key("doc_id", "text", blocks)).cast("int"))

    def keys(rows: pa.Table) -> pa.Table:
        block = rows["__block"][0].as_py()
        rows = in_order(rows)
        found, ids = Keys(rows, least_chars), ids_of(rows)
        a = found.a[found.first]
        sent = list(send(a, bits, [a, found.b[found.first], ids[found.doc[found.first]]]))
        return pa.table(
            [pa.array([b for b, _ in sent], pa.int32()), pa.array([block] * len(sent), pa.int32()), pa.array([d for _, d in sent], pa.binary())],
            names=["bucket", "block", "data"],
        )

    schema = "bucket int, block int, data binary"
    staged = scratch_path(spark, "lines-keys")
    messages = dealt.select("doc_id", "text", "__block").groupBy("__block").applyInArrow(keys, schema)
    messages.withColumn("batch", F.floor(F.col("block") / blocks).cast("int")).write.partitionBy("batch").parquet(staged)
    index = LineIndex(spark, bits, fanout)
    everything = spark.read.schema(schema + ", batch int").parquet(staged)
    answers = None
    for i in range(batches):
        answered = index.add(everything.filter(F.col("batch") == i).drop("batch"))
        answers = answered if answers is None else answers.unionByName(answered)

    def finish(rows: pa.Table, answered: Answers) -> pa.Table:
        found, ids = Keys(rows, least_chars), ids_of(rows)
        a = found.a[found.first]
        later = answered.flags(np.diff(bucket_bounds(a, bits)))
        line_ids = ids[found.doc]
        drop = later[found.rank] | (line_ids > line_ids[found.first][found.rank]) if len(a) else np.zeros(0, bool)
        gone = np.zeros(len(found.starts), dtype=bool)
        gone[found.line[drop]] = True
        raw = found.data.tobytes()
        texts = []
        for i in range(rows.num_rows):
            lo, hi = found.bounds[i], found.bounds[i + 1]
            if gone[lo:hi].any():
                texts.append(b"\n".join(raw[found.starts[k] : found.ends[k]] for k in range(lo, hi) if not gone[k]).decode())
            else:
                texts.append(raw[found.offsets[i] : found.offsets[i + 1]].decode())
        dropped = np.concatenate([[0], np.cumsum(gone)])
        out = rows.drop_columns(["__block"]).append_column("n_lines", pa.array(np.diff(found.bounds)))
        out = out.append_column("n_dropped", pa.array(dropped[found.bounds[1:]] - dropped[found.bounds[:-1]]))
        return out.append_column("kept_text", pa.array(texts, pa.string()))

    added = [T.StructField(n, t) for n, t in (("n_lines", T.LongType()), ("n_dropped", T.LongType()), ("kept_text", T.StringType()))]
    return settle(dealt, answers, bits, finish, T.StructType([*docs.schema.fields, *added])).withColumnsRenamed(back)


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has, removed from every text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), "text")
    return remove_repeated_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256")
    )
