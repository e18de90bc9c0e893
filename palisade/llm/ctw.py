"""Language-model scoring by context-tree weighting over bytes.

Every byte is eight binary decisions, most significant first. A node is a context of up to `depth` preceding
bytes together with the bits of the current byte decided so far; it counts zeros and ones, and its
Krichevsky-Trofimov estimate of them is mixed half and half with the product of its children's weighted
probabilities (contexts one byte longer). The tree is learned from counts, so it does not depend on the order
of the texts; scoring uses the finished tree. Bytes before a text's start are zero.

Counts of strings of depth + 1 bytes (five as registered, eight at most) are dealt by the two nearest context bytes, so a
bucket holds whole subtrees from depth 2 on; above that at most 65,280 nodes exist, which are summed by Spark and sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.blocks import ask, block_count, block_key, bucket_bits, bucket_of, in_order
from palisade.llm.language import held_out
from palisade.llm.spans import LOWER, batches, flat, hash_spans, mix, pack, unpack, word_spans
from palisade.session import materialize

U64 = np.uint64
DEPTH = 4
SLICE_BYTES = 2 << 20
_MODEL = "kind string, bucket int, data binary, n long, v long"


def strings_of(texts, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """For each byte the key of its context bytes, the nearest first, and itself; and the texts' offsets."""
    data, offsets = flat(texts)
    low = LOWER[data].astype(np.uint64)
    keys = low.copy()
    starts = offsets[:-1]
    lengths = np.diff(offsets)
    for back in range(1, depth + 1):
        before = np.zeros_like(low)
        before[back:] = low[:-back]
        for i in range(back):
            before[(starts + i)[lengths > i]] = 0
        keys |= before << U64(8 * (depth + 1 - back))
    return keys, offsets


def tokens_of(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in lower case, and where each text's begin."""
    data, offsets = flat(texts)
    data = LOWER[data]
    starts, ends, bounds = word_spans(data, offsets)
    return hash_spans(data, starts, ends), bounds


def _string_bucket(keys: np.ndarray, bits: int, depth: int) -> np.ndarray:
    return bucket_of(mix((keys >> U64(8 * (depth - 1))) + U64(1)), bits)


def _grouped(buckets: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Packed arrays of each bucket; buckets ascend."""
    first = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]])) if len(buckets) else np.zeros(0, np.int64)
    for lo, hi in zip(first, np.append(first[1:], len(buckets))):
        yield int(buckets[lo]), pack(*(a[lo:hi] for a in arrays))


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order and their sums."""
    codes, distinct = pd.factorize(keys)
    # Sums of counts stay far below 2^53, so floats hold them exactly.
    sums = np.bincount(codes, weights=n, minlength=len(distinct)).astype(n.dtype)
    order = np.argsort(distinct)
    return distinct[order], sums[order]


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes, distinct = pd.factorize(keys)
    n = np.bincount(codes, minlength=len(distinct))
    order = np.argsort(distinct)
    return distinct[order], n[order]


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """ln gamma for x > 0: Stirling's series at x + 8, stepped down."""
    y = x + 8.0
    series = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    steps = np.ones_like(x)
    for i in range(8):
        steps = steps * (x + i)
    return series - np.log(steps)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with that many zeros and ones."""
    a, b = zeros.astype(float), ones.astype(float)
    return _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1.0) - np.log(np.pi)


@dataclass(frozen=True)
class Nodes:
    """Nodes of one depth by key (context * 256 + bits so far with a leading one), with their counts and own weight."""

    keys: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    log_weighted: np.ndarray
    own: np.ndarray  # posterior weight of the node's own estimate; the rest is its children's


def _nodes(keys: np.ndarray, n: np.ndarray, children: Nodes | None) -> Nodes:
    """Nodes of one depth from the counts of (context, byte) in ascending order."""
    context, byte = keys >> U64(8), keys & U64(0xFF)
    found, zeros, ones = [], [], []
    for level in range(8):
        node = (context << U64(8)) | U64(1 << level) | (byte >> U64(8 - level))
        bit = ((byte >> U64(7 - level)) & U64(1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        found.append(node[first])
        ones.append(np.add.reduceat(n * bit, first))
        zeros.append(np.add.reduceat(n * (1 - bit), first))
    node = np.concatenate(found)
    order = np.argsort(node)
    node, zeros, ones = node[order], np.concatenate(zeros)[order], np.concatenate(ones)[order]
    kt = log_kt(zeros, ones)
    if children is None:
        return Nodes(node, zeros, ones, kt, np.ones(len(node)))
    below = _summed(_shorter(children.keys), children.log_weighted)[1]
    return _mixed(node, zeros, ones, kt, below)


def _mixed(node, zeros, ones, kt, below) -> Nodes:
    weighted = np.logaddexp(kt, below) - np.log(2)
    return Nodes(node, zeros, ones, weighted, np.exp(kt - np.log(2) - weighted))


def _shorter(keys: np.ndarray) -> np.ndarray:
    """Keys without their farthest context byte; the last eight bits stay."""
    return ((keys >> U64(16)) << U64(8)) | (keys & U64(0xFF))


def subtrees(keys: np.ndarray, n: np.ndarray, depth: int = DEPTH) -> dict[int, Nodes]:
    """Nodes of all depths down to 2 from counts of strings in ascending order."""
    out, below = {}, None
    for level in range(depth, 1, -1):
        below = out[level] = _nodes(keys, n, below)
        if level > 2:
            keys, n = _summed(_shorter(keys), n)
    return out


def _top(rows: pa.Table) -> dict[int, Nodes]:
    """Nodes of depth 1 and 0 from the sums over their children."""
    order = np.argsort(rows["node"].to_numpy())
    node, zeros, ones, below = (rows[c].to_numpy()[order] for c in ("node", "zeros", "ones", "below"))
    first = _mixed(node.astype(np.uint64), zeros, ones, log_kt(zeros, ones), below)
    root_of = node & 0xFF
    zeros, ones = (np.bincount(root_of, weights=x, minlength=256)[1:] for x in (zeros, ones))
    below = np.bincount(root_of, weights=first.log_weighted, minlength=256)[1:]
    root = np.arange(1, 256, dtype=np.uint64)
    return {1: first, 0: _mixed(root, zeros, ones, log_kt(zeros, ones), below)}


def log10_probabilities(strings: np.ndarray, trees: dict[int, Nodes], deepest: int = DEPTH) -> np.ndarray:
    """log10 of the weighted probability of each string's last byte after its context; a context never seen says 1/2."""
    byte = strings & U64(0xFF)
    total = np.zeros(len(strings))
    for level in range(8):
        node = U64(1 << level) | (byte >> U64(8 - level))
        one = ((byte >> U64(7 - level)) & U64(1)).astype(bool)
        p = np.full(len(strings), 0.5)
        for depth in range(deepest, -1, -1):
            tree = trees[depth]
            # A shift by all 64 bits would leave them as they are.
            context = strings >> U64(8 * (deepest + 1 - depth)) if depth else np.zeros(len(strings), dtype=np.uint64)
            key = (context << U64(8)) | node
            if len(tree.keys) == 0:
                continue
            at = np.minimum(np.searchsorted(tree.keys, key), len(tree.keys) - 1)
            seen = tree.keys[at] == key
            n = np.where(one, tree.ones[at], tree.zeros[at])
            estimate = (n + 0.5) / (tree.zeros[at] + tree.ones[at] + 1.0)
            p = np.where(seen, tree.own[at] * estimate + (1 - tree.own[at]) * p, 0.5)
        total += np.log10(p)
    return total


@dataclass(frozen=True)
class Model:
    """Counts in a written table (kind, bucket, data), the top of the tree, and the sizes of the token counts."""

    table: DataFrame
    top: dict
    bits: int
    tokens: int
    distinct: int
    texts: int
    depth: int = DEPTH


def fit(docs: DataFrame, bits: int, depth: int = DEPTH) -> Model:
    """Learn from all texts of `docs` (text; a null text counts as empty). `bits`: buckets as a power of two; `depth`: 2 to 7."""
    if not 2 <= depth <= 7:
        raise ValueError("a string of at most seven context bytes and its last byte has to fit 64 bits")

    def count(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0, np.uint64), np.zeros(0, np.int64)) for _ in range(2)]
        texts = 0

        def rows():
            strings, tokens = held
            bucket = _string_bucket(strings[0], bits, depth)
            order = np.lexsort((strings[0], bucket))
            sent = [("string", b, d) for b, d in _grouped(bucket[order], strings[0][order], strings[1][order])]
            sent += [("token", b, d) for b, d in _grouped(bucket_of(tokens[0], bits), *tokens)]
            return pa.RecordBatch.from_arrays(
                [pa.array([s[0] for s in sent], pa.string()), pa.array([s[1] for s in sent], pa.int32()), pa.array([s[2] for s in sent], pa.binary()),
                 pa.array([0] * len(sent), pa.int64()), pa.array([0] * len(sent), pa.int64())],
                ["kind", "bucket", "data", "n", "v"],
            )

        for table in tables:
            for part in batches(pa.Table.from_batches([table]), SLICE_BYTES, "text"):
                texts += part.num_rows
                for i, keys in enumerate((strings_of(part["text"], depth)[0], tokens_of(part["text"])[0])):
                    keys, n = _counted(keys)
                    held[i] = _summed(np.concatenate([held[i][0], keys]), np.concatenate([held[i][1], n]))
                if len(held[0][0]) + len(held[1][0]) > 4_000_000:
                    yield rows()
                    held = [(h[0][:0], h[1][:0]) for h in held]
        yield rows()
        # Every text ends with one end token of its own.
        yield pa.RecordBatch.from_arrays([pa.array(["end"]), pa.array([0], pa.int32()), pa.array([b""]), pa.array([texts]), pa.array([0])], ["kind", "bucket", "data", "n", "v"])

    def merge(rows: pa.Table) -> pa.Table:
        kind, bucket = rows["kind"][0].as_py(), rows["bucket"][0].as_py()
        if kind == "end":
            n = pa.compute.sum(rows["n"]).as_py()
            out = [("end", 0, b"", n, int(n > 0))]
        else:
            parts = [unpack(d.as_py(), np.uint64, np.int64) for d in rows["data"]]
            keys, n = _summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            out = [(kind, bucket, pack(keys, n), int(n.sum()), len(keys))]
            if kind == "string":
                second = subtrees(keys, n, depth)[2]
                node = (second.keys >> U64(16) << U64(8)) | (second.keys & U64(0xFF))
                codes, distinct = pd.factorize(node)
                sums = [np.bincount(codes, weights=x, minlength=len(distinct)) for x in (second.zeros, second.ones, second.log_weighted)]
                out.append(("top", bucket, pack(distinct.astype(np.int64), *sums), 0, 0))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.int64()))], names=["kind", "bucket", "data", "n", "v"])

    counted = docs.select("text").mapInArrow(count, _MODEL)
    table = materialize(counted.groupBy("kind", "bucket").applyInArrow(merge, _MODEL), "ctw-model")

    def spread(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in tables:
            for data in rows["data"].to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in unpack(data, np.int64, float, float, float)], ["node", "zeros", "ones", "below"])

    tops = table.filter("kind = 'top'").select("data").mapInArrow(spread, "node long, zeros double, ones double, below double")
    # At most 256 contexts of one byte times 255 nodes.
    top = _top(tops.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")]).toArrow())
    ends = F.sum(F.when(F.col("kind") == "end", F.col("n")))
    sizes = table.filter("kind IN ('token', 'end')").agg(F.sum("n"), F.sum("v"), ends).first()
    return Model(table.select("kind", "bucket", "data"), top, bits, *(int(x or 0) for x in sizes), depth)


def score(docs: DataFrame, model: Model, blocks: int) -> DataFrame:
    """doc_id, flag, n_tokens, n_known, known_logs, score, n_bytes for each row of `docs` (doc_id, text, flag).

    score is the model's log10 probability of the text in lower case; known_logs the sum of log10(c + 1) over its
    words with their training counts c. n_known counts known words; the end token is left to the caller.
    """
    bits, buckets, depth = model.bits, 1 << model.bits, model.depth
    sent_top = docs.sparkSession.sparkContext.broadcast(model.top)
    dealt = docs.withColumn("__block", block_key("doc_id", "text", blocks))

    def asked(texts) -> tuple:
        keys, offsets = strings_of(texts, depth)
        tokens, bounds = tokens_of(texts)
        codes, distinct = pd.factorize(keys)
        bucket = _string_bucket(distinct, bits, depth)
        order = np.lexsort((distinct, bucket))
        token_codes, token_distinct = pd.factorize(tokens)
        token_order = np.argsort(token_distinct)
        return (codes, distinct, bucket, order, offsets), (token_codes, token_distinct, token_order, bounds)

    def ask_block(rows: pa.Table, _, __) -> Iterator[tuple[int, bytes]]:
        (_, distinct, bucket, order, _), (_, tokens, token_order, _) = asked(rows["text"])
        yield from _grouped(bucket[order], distinct[order])
        tokens = tokens[token_order]
        yield from _grouped(bucket_of(tokens, bits) + buckets, tokens)

    def reply(rows: pa.Table, held: pa.Table) -> pa.Table:
        if rows.num_rows == 0:
            return pa.table([pa.array([], pa.int32()), pa.array([], pa.int32()), pa.array([], pa.binary())], names=["bucket", "block", "data"])
        parts = [unpack(d.as_py(), np.uint64)[0] for d in rows["data"]]
        codes, distinct = pd.factorize(np.concatenate(parts))
        known = unpack(held["data"][0].as_py(), np.uint64, np.int64) if held.num_rows else [np.zeros(0, np.uint64), np.zeros(0, np.int64)]
        if rows["bucket"][0].as_py() < buckets:
            empty = Nodes(*(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, float, float)))
            deep = {k: empty for k in range(2, depth + 1)} if len(known[0]) == 0 else subtrees(*known, depth)
            values = log10_probabilities(distinct, {**deep, **sent_top.value}, depth)
        else:
            values = np.zeros(len(distinct))
            if len(known[0]):
                at = np.minimum(np.searchsorted(known[0], distinct), len(known[0]) - 1)
                values = np.where(known[0][at] == distinct, known[1][at], 0).astype(float)
        bounds = np.cumsum([0, *(len(p) for p in parts)])
        answers = [pack(values[codes[lo:hi]]) for lo, hi in zip(bounds[:-1], bounds[1:])]
        return pa.table([rows["bucket"], rows["block"], pa.array(answers, pa.binary())], names=["bucket", "block", "data"])

    def finish(rows: pa.Table, answers: pa.Table) -> pa.Table:
        rows = in_order(rows)
        (codes, distinct, _, order, offsets), (token_codes, tokens, token_order, bounds) = asked(rows["text"])
        by_bucket = dict(zip(answers["bucket"].to_pylist(), answers["data"].to_pylist()))
        values = [np.zeros(0), np.zeros(0)]
        for i, mine in enumerate((lambda b: b < buckets, lambda b: b >= buckets)):
            found = [unpack(by_bucket[b], float)[0] for b in sorted(by_bucket) if mine(b)]
            values[i] = np.concatenate(found) if found else values[i]
        logs, counts = np.zeros(len(distinct)), np.zeros(len(tokens))
        logs[order], counts[token_order] = values

        def sums(x, at):
            out = np.zeros(len(at) - 1)
            full = np.diff(at) > 0
            if full.any():
                out[full] = np.add.reduceat(x, at[:-1][full])
            return out

        c = counts[token_codes]
        return pa.table(
            {
                "doc_id": rows["doc_id"].cast(pa.int64()),
                "flag": rows["flag"],
                "n_tokens": np.diff(bounds) + 1,
                "n_known": sums((c > 0).astype(float), bounds).astype(np.int64),
                "known_logs": sums(np.log10(c + 1), bounds),
                "score": sums(logs[codes], offsets),
                "n_bytes": np.diff(offsets),
            }
        )

    table = model.table.filter("kind IN ('string', 'token')").select(
        F.when(F.col("kind") == "string", F.col("bucket")).otherwise(F.col("bucket") + buckets).alias("bucket"), "data"
    )
    messages = ask(dealt.select("doc_id", "text", "flag", "__block"), None, bits + 1, ask_block)
    replies = messages.groupBy("bucket").cogroup(table.groupBy("bucket")).applyInArrow(reply, "bucket int, block int, data binary")
    schema = "doc_id long, flag boolean, n_tokens long, n_known long, known_logs double, score double, n_bytes long"
    return dealt.select("doc_id", "text", "flag", "__block").groupBy("__block").cogroup(replies.groupBy("block")).applyInArrow(finish, schema)


def score_texts(docs: DataFrame, modulus: int = 7, remainder: int = 2, blocks: int | None = None, depth: int = DEPTH) -> DataFrame:
    """Scores of every row of `docs` (doc_id, text), learned from the rows that are not held out.

    Held out are rows whose crc32 of the id as text leaves `remainder` by `modulus`; a row without an id is not. A
    null text is empty: one token (the end), score 0.0 and no bits_per_byte. Other columns are left out.
    `depth` is how many bytes a context has at most. Returns
    doc_id, held_out, n_tokens, n_known, train_tokens, base_score (the add-one unigram model), score (the tree's
    log10 probability of the text in lower case) and bits_per_byte (the tree's code length).
    """
    blocks = blocks or block_count(docs)
    flagged = docs.select(F.col("doc_id").cast("long"), "text", held_out("doc_id", modulus, remainder).alias("flag"))
    model = fit(flagged.filter(~F.col("flag")).select("text"), bucket_bits(blocks), depth)
    scored = score(flagged, model, blocks)
    base = F.col("known_logs") + F.lit(float(np.log10(model.texts + 1.0))) - F.col("n_tokens") * F.lit(float(np.log10(model.tokens + model.distinct + 1.0)))
    return scored.select(
        "doc_id", F.col("flag").alias("held_out"), "n_tokens", (F.col("n_known") + int(model.texts > 0)).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
        F.when(F.col("n_bytes") > 0, -F.col("score") * F.lit(float(np.log2(10.0))) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op8_lm_score(spark, sf_dir: str) -> DataFrame:
    """Unigram and context-tree scores of every document."""
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
