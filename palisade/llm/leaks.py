"""Benchmark decontamination: a prefix-filtered join of item windows with documents, verified word by word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.llm.blocks import text_bytes
from palisade.llm.runtime import hide_columns
from palisade.llm.spans import LOWER, batches, covered, flat, hash_spans, word_spans

WINDOW_WORDS = 10
SHINGLE_WORDS = 3
SLICE_BYTES = 2 << 20
# Item texts that one pass over the documents compares; beyond it the items are taken in several passes.
SIDE_BYTES = 16 << 20
APART = np.zeros(256, dtype=bool)
APART[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
_SIEVE_BITS = 22


def words_of(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased, runs of letters, digits and non-ASCII bytes), and where each text's begin."""
    data, offsets = flat(texts)
    data = LOWER[data]
    starts, ends, bounds = word_spans(data, offsets, APART)
    return hash_spans(data, starts, ends), bounds


def _windows(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and item of every window: ten consecutive words, or all of an item with fewer."""
    counts = np.diff(bounds)
    size = np.minimum(counts, WINDOW_WORDS)
    n = np.where(counts > 0, counts - size + 1, 0)
    item = np.repeat(np.arange(len(counts)), n)
    start = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n) + bounds[:-1][item]
    return start, size[item], item


def _shingles(words: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    return hash_spans(words, starts, starts + size)


def _sieve(hashes: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << _SIEVE_BITS, dtype=bool)
    table[(hashes & np.uint64((1 << _SIEVE_BITS) - 1)).astype(np.int64)] = True
    return table


def _find(sorted_keys: np.ndarray, sieve: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the hashes that are among the keys, and which key each is."""
    at = np.flatnonzero(sieve[(hashes & np.uint64((1 << _SIEVE_BITS) - 1)).astype(np.int64)])
    if len(sorted_keys) == 0 or len(at) == 0:
        return at[:0], at[:0]
    key = np.minimum(np.searchsorted(sorted_keys, hashes[at]), len(sorted_keys) - 1)
    hit = sorted_keys[key] == hashes[at]
    return at[hit], key[hit]


def _shingle_starts(bounds: np.ndarray, size: int) -> np.ndarray:
    """Starts of all shingles of that many words that lie within one text."""
    n = np.maximum(np.diff(bounds) - size + 1, 0)
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(bounds[:-1], n)


@dataclass(frozen=True)
class _Side:
    """Windows of some items, keyed by the one shingle of each that is rarest in the documents.

    An exact occurrence must contain all shingles of its window, so the prefix of its shingles ordered by
    rarity that every match has to share is one shingle long.
    """

    items: tuple[str | None, ...]
    keys: dict  # shingle size -> distinct keys in ascending order
    groups: dict  # shingle size -> for each key the first and last entry
    offset: np.ndarray  # of each entry: where the key stands in its window
    length: np.ndarray
    window: np.ndarray  # which distinct window
    hash_a: np.ndarray
    hash_b: np.ndarray
    owner_at: np.ndarray  # of each distinct window: where its items begin
    owner: np.ndarray


def _count_shingles(docs: DataFrame, wanted: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """How often each wanted shingle occurs in all documents."""
    sent = docs.sparkSession.sparkContext.broadcast({k: (v, _sieve(v)) for k, v in wanted.items()})

    def count(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros(len(v), dtype=np.int64) for k, (v, _) in sent.value.items()}
        for table in tables:
            for part in batches(pa.Table.from_batches([table]), SLICE_BYTES, "text"):
                words, bounds = words_of(part["text"])
                for size, (keys, sieve) in sent.value.items():
                    starts = _shingle_starts(bounds, size)
                    _, key = _find(keys, sieve, _shingles(words, starts, size))
                    sums[size] += np.bincount(key, minlength=len(keys))
        for size, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), size)), pa.array(at), pa.array(n[at])], ["size", "key", "n"])

    counted = docs.select("text").mapInArrow(count, "size long, key long, n long").groupBy("size", "key").agg(F.sum("n").alias("n"))
    out = {k: np.zeros(len(v), dtype=np.int64) for k, v in wanted.items()}
    # One row for each shingle of one pass's items at most.
    table = counted.toArrow()
    for size in out:
        chosen = table.filter(pa.compute.equal(table["size"], size))
        out[size][chosen["key"].to_numpy()] = chosen["n"].to_numpy()
    return out


def _side(items: pa.Table, docs: DataFrame) -> _Side:
    words, bounds = words_of(items["text"])
    start, length, item = _windows(words, bounds)
    hash_a, hash_b = hash_spans(words, start, start + length), hash_spans(words, start, start + length, 1)
    size = np.minimum(length, SHINGLE_WORDS)
    wanted, shingle_at = {}, {}
    for k in np.unique(size).tolist():
        at = _shingle_starts(bounds, k)
        hashes = _shingles(words, at, k)
        wanted[k] = np.array(sorted(set(hashes.tolist())), dtype=np.uint64)
        code = np.full(len(words) + 1, -1, dtype=np.int64)
        code[at] = np.searchsorted(wanted[k], hashes)
        shingle_at[k] = code
    counts = _count_shingles(docs, wanted)

    # Equal windows of several items are one entry.
    order = np.lexsort((start, hash_b, hash_a))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (hash_a[order][1:] != hash_a[order][:-1]) | (hash_b[order][1:] != hash_b[order][:-1])
    first = order[new]
    keys, groups, rows = {}, {}, []
    for k in wanted:
        mine = np.flatnonzero(size[first] == k)
        w = first[mine]
        best = np.zeros(len(w), dtype=np.int64)
        fewest = np.full(len(w), np.iinfo(np.int64).max)
        for j in range(WINDOW_WORDS - k + 1):
            fits = length[w] >= j + k
            n = np.where(fits, counts[k][shingle_at[k][np.minimum(start[w] + j, len(words))]], np.iinfo(np.int64).max)
            better = n < fewest
            best[better], fewest[better] = j, n[better]
        key = shingle_at[k][start[w] + best]
        by_key = np.argsort(key, kind="stable")
        begin = sum(len(r) for r in rows)
        rows.append(np.column_stack([mine[by_key], best[by_key]]))
        used, at = np.flatnonzero(np.bincount(key, minlength=len(wanted[k]))), np.sort(key)
        keys[k] = wanted[k][used]
        groups[k] = (begin + np.searchsorted(at, used), begin + np.searchsorted(at, used, side="right"))
    entry = np.concatenate(rows) if rows else np.zeros((0, 2), dtype=np.int64)
    owner_at = np.append(np.flatnonzero(new), len(order))
    return _Side(
        tuple(items["item_id"].to_pylist()), keys, groups, entry[:, 1], length[first][entry[:, 0]], entry[:, 0],
        hash_a[first][entry[:, 0]], hash_b[first][entry[:, 0]], owner_at, item[order],
    )


def _match(side: _Side, sieves: dict, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and distinct window of every occurrence."""
    found = []
    for size, keys in side.keys.items():
        starts = _shingle_starts(bounds, size)
        at, key = _find(keys, sieves[size], _shingles(words, starts, size))
        lo, hi = (g[key] for g in side.groups[size])
        entry = np.arange(int((hi - lo).sum())) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
        start = np.repeat(starts[at], hi - lo) - side.offset[entry]
        end = start + side.length[entry]
        doc = np.repeat(np.searchsorted(bounds, starts[at], side="right") - 1, hi - lo)
        inside = (start >= bounds[doc]) & (end <= bounds[doc + 1])
        found.append((start[inside], end[inside], entry[inside]))
    start, end, entry = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    # Hashing needs bounds that ascend in both ends: by length, then by start.
    hit = np.zeros(len(start), dtype=bool)
    for length in set((end - start).tolist()):
        mine = np.flatnonzero(end - start == length)
        mine = mine[np.argsort(start[mine], kind="stable")]
        lo, hi = start[mine], end[mine]
        hit[mine] = (hash_spans(words, lo, hi) == side.hash_a[entry[mine]]) & (hash_spans(words, lo, hi, 1) == side.hash_b[entry[mine]])
    return start[hit], end[hit], side.window[entry[hit]]


def find_leaks(docs: DataFrame, items: DataFrame, side_bytes: int = SIDE_BYTES) -> DataFrame:
    """All columns of `docs` and: n_words, n_hit (words inside an occurrence of an item's window), leaked_items, n_items.

    `items` needs item_id and text. A window is ten consecutive words of an item; an item of fewer words, but
    not none, is one window. leaked_items lists the ids, as strings in ascending order without repeats, of the
    items with an occurring window. A null text has no words; rows of equal item_id count as one item. An item
    without an id is matched as any other: its words are in n_hit and all such items are one in n_items, but
    leaked_items has no id to list. Items are compared with all documents in passes of at most `side_bytes` of item text (or one item); one pass is one scan without a shuffle.
    Columns of `docs` with these names are replaced.
    """
    spark = docs.sparkSession
    docs, back = hide_columns(docs.drop("n_words", "n_hit", "leaked_items", "n_items"), "__hits")
    items = items.select(F.col("item_id").cast("string"), "text")
    passes = max(1, -(-text_bytes(items) // side_bytes))
    out = docs.withColumn("__hits", F.array().cast("array<struct<lo:int,hi:int>>")).withColumn("leaked_items", F.array().cast("array<string>"))
    for i in range(passes):
        part = items if passes == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == i)
        # At most about `side_bytes` of text by the number of passes above.
        side = _side(part.toArrow(), docs)
        out = _one_pass(out, spark.sparkContext.broadcast((side, {k: _sieve(v) for k, v in side.keys.items()})))
    # Until here a null in the list stands for the items without an id.
    found = _counted(out).withColumn("n_items", F.size("leaked_items").cast("long"))
    return found.withColumn("leaked_items", F.array_compact("leaked_items")).withColumnsRenamed(back)


def _one_pass(docs: DataFrame, sent) -> DataFrame:
    def scan(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side, sieves = sent.value
        for table in tables:
            for part in batches(pa.Table.from_batches([table]), SLICE_BYTES, "text"):
                words, bounds = words_of(part["text"])
                start, end, window = _match(side, sieves, words, bounds)
                order = np.argsort(start, kind="stable")
                start, end, window = start[order], end[order], window[order]
                doc = np.searchsorted(bounds, start, side="right") - 1
                hits, leaked = part["__hits"].to_pylist(), part["leaked_items"].to_pylist()
                found, firsts = np.unique(doc, return_index=True)
                for d, lo, hi in zip(found.tolist(), firsts, [*firsts[1:], len(doc)]):
                    mine, base = slice(lo, hi), bounds[d]
                    flags = covered(int(bounds[d + 1] - base), start[mine] - base, end[mine] - base)
                    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
                    hits[d] = hits[d] + [{"lo": int(a), "hi": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]
                    owners = np.concatenate([side.owner[side.owner_at[w] : side.owner_at[w + 1]] for w in set(window[mine].tolist())])
                    leaked[d] = sorted({*leaked[d], *(side.items[k] for k in owners.tolist())}, key=lambda x: (x is None, x or ""))
                out = part.set_column(part.schema.get_field_index("__hits"), "__hits", pa.array(hits, part.schema.field("__hits").type))
                out = out.set_column(out.schema.get_field_index("leaked_items"), "leaked_items", pa.array(leaked, pa.list_(pa.string())))
                yield from out.to_batches()

    return docs.mapInArrow(scan, docs.schema)


def _counted(docs: DataFrame) -> DataFrame:
    fields = [f for f in docs.schema.fields if f.name not in ("__hits", "leaked_items")]
    schema = T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), docs.schema["leaked_items"]])

    def count(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            for part in batches(pa.Table.from_batches([table]), SLICE_BYTES, "text"):
                data, offsets = flat(part["text"])
                n = np.diff(word_spans(LOWER[data], offsets, APART)[2])
                n_hit = np.zeros(len(n), dtype=np.int64)
                for i, spans in enumerate(part["__hits"].to_pylist()):
                    if spans:
                        n_hit[i] = covered(int(n[i]), np.array([s["lo"] for s in spans]), np.array([s["hi"] for s in spans])).sum()
                leaked = part["leaked_items"]
                out = part.drop_columns(["__hits", "leaked_items"]).append_column("n_words", pa.array(n)).append_column("n_hit", pa.array(n_hit))
                yield from out.append_column("leaked_items", leaked).to_batches()

    return docs.mapInArrow(count, schema)


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of `docs` without an occurring window of `items`; columns as they were."""
    docs, back = hide_columns(docs, "n_words", "n_hit", "leaked_items", "n_items")
    return find_leaks(docs, items).filter("n_hit = 0").select(*docs.columns).withColumnsRenamed(back)


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Which words and documents hold passages of the benchmark, and of which items."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), "text")
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    joined = F.concat_ws(",", "leaked_items")
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.encode(joined, "UTF-8"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
