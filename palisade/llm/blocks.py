"""Blocks and buckets: how the operators of this package compare all texts with all texts.

Documents are dealt by id into blocks of bounded size. A block sends each bucket (a part of the hash
space, chosen by the top bits of a hash) the distinct hashes it holds, once each and sorted, as one packed
row; a bucket merges what all blocks sent and answers each block. So a hash that is frequent in the corpus
costs one entry for each block that holds it, however many rows do, and no group of rows ever meets in one
task. Texts are shuffled once: Spark reuses that exchange in every round of one plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.spans import pack, unpack

BLOCK_BYTES = 6 << 20
MESSAGE = "bucket int, block int, data binary"
_ARROW = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("data", pa.binary())])
LAST_ID = np.iinfo(np.int64).max  # stands for a null id

# bucket, data
Sent = Iterator[tuple[int, bytes]]


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return int(docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0)


def block_count(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks that hold about `block_bytes` of text each."""
    return max(1, -(-text_bytes(docs, text) // block_bytes))


def bucket_bits(blocks: int) -> int:
    return max(0, (blocks - 1).bit_length())


def block_key(doc_id: str, text: str, blocks: int) -> Column:
    """Rows of one id share a block; rows without an id are dealt by their text."""
    return F.pmod(F.xxhash64(F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(F.col(text)))), F.lit(blocks)).cast("int")


def bucket_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    if bits == 0:
        return np.zeros(len(hashes), dtype=np.int64)
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def bucket_bounds(sorted_hashes: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket begins among sorted hashes, and their number at the end."""
    if bits == 0:
        return np.array([0, len(sorted_hashes)])
    tops = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate([[0], np.searchsorted(sorted_hashes, tops), [len(sorted_hashes)]])


def send(sorted_hashes: np.ndarray, bits: int, arrays: list[np.ndarray]) -> Sent:
    """Each bucket's part of arrays that are sorted as the hashes are."""
    bounds = bucket_bounds(sorted_hashes, bits)
    for bucket in np.flatnonzero(np.diff(bounds)):
        part = slice(bounds[bucket], bounds[bucket + 1])
        yield int(bucket), pack(*(a[part] for a in arrays))


def in_order(docs: pa.Table) -> pa.Table:
    """Rows by id, nulls last, ties by text: the same order in every round."""
    order = [("doc_id", "ascending"), ("text", "ascending")]
    return docs.take(pa.compute.sort_indices(docs, sort_keys=order, null_placement="at_end"))


def ids_of(docs: pa.Table) -> np.ndarray:
    return pa.compute.fill_null(docs["doc_id"].cast(pa.int64()), int(LAST_ID)).to_numpy()


class Answers:
    """What the buckets and the block itself have sent to a block."""

    def __init__(self, table: pa.Table | None, buckets: int):
        pairs = zip(table["bucket"].to_pylist(), table["data"].to_pylist()) if table is not None else ()
        self.by_bucket, self.state = {}, None
        for bucket, data in pairs:
            if bucket < buckets:
                self.by_bucket[bucket] = data
            else:
                self.state = data

    def flags(self, counts: np.ndarray) -> np.ndarray:
        """The answered bits of all buckets in order; counts: how many each bucket was asked."""
        out = [np.zeros(0, dtype=bool)]
        for bucket in np.flatnonzero(counts):
            n = int(counts[bucket])
            out.append(np.unpackbits(np.frombuffer(self.by_bucket[int(bucket)], np.uint8), count=n).astype(bool))
        return np.concatenate(out)


def _messages(block: int, sent: Sent) -> pa.Table:
    rows = list(sent)
    return pa.table(
        [pa.array([b for b, _ in rows], pa.int32()), pa.array([block] * len(rows), pa.int32()), pa.array([d for _, d in rows], pa.binary())],
        schema=_ARROW,
    )


def ask(docs: DataFrame, answers: DataFrame | None, bits: int, ask_block: Callable[[pa.Table, Answers, int], Sent]) -> DataFrame:
    """Every block's messages to the buckets. `docs`: __block, doc_id, text; `answers` are those of the round before."""
    buckets = 1 << bits

    def alone(docs_: pa.Table) -> pa.Table:
        block = docs_["__block"][0].as_py()
        return _messages(block, ask_block(in_order(docs_), Answers(None, buckets), buckets + block))

    def again(docs_: pa.Table, answers_: pa.Table) -> pa.Table:
        if docs_.num_rows == 0:
            return _messages(0, iter(()))
        block = docs_["__block"][0].as_py()
        return _messages(block, ask_block(in_order(docs_), Answers(answers_, buckets), buckets + block))

    if answers is None:
        return docs.groupBy("__block").applyInArrow(alone, MESSAGE)
    return docs.groupBy("__block").cogroup(answers.groupBy("block")).applyInArrow(again, MESSAGE)


def answer(messages: DataFrame, bits: int, decide: Callable[[list[bytes]], list[np.ndarray]]) -> DataFrame:
    """One bucket at a time: flags for each message's entries. Messages of a block to itself pass through."""
    buckets = 1 << bits

    def bucket(rows: pa.Table) -> pa.Table:
        if rows["bucket"][0].as_py() >= buckets:
            return rows.select(["bucket", "block", "data"]).cast(_ARROW)
        flags = decide([d.as_py() for d in rows["data"]])
        return pa.table([rows["bucket"], rows["block"], pa.array([np.packbits(f).tobytes() for f in flags], pa.binary())], schema=_ARROW)

    return messages.groupBy("bucket").applyInArrow(bucket, MESSAGE)


def settle(docs: DataFrame, answers: DataFrame, bits: int, finish: Callable[[pa.Table, Answers], pa.Table], schema: str) -> DataFrame:
    """Each block's rows of the result, from its texts and the answers of the last round."""
    buckets = 1 << bits

    def last(docs_: pa.Table, answers_: pa.Table) -> pa.Table:
        return finish(in_order(docs_), Answers(answers_, buckets))

    return docs.groupBy("__block").cogroup(answers.groupBy("block")).applyInArrow(last, schema)


def split_keys(datas: list[bytes], *kinds) -> tuple[list[np.ndarray], np.ndarray]:
    """Entries of all messages behind each other, and where each message begins."""
    parts = [unpack(d, *kinds) for d in datas]
    sizes = np.cumsum([0, *(len(p[0]) for p in parts)])
    return [np.concatenate(column) for column in zip(*parts)], sizes
