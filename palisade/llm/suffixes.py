"""Suffix deduplication: repeated byte strings, by blockwise sorting of a difference-cover sample of all suffixes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.blocks import block_count, block_key, bucket_bits
from palisade.llm.cover import WIDE_BLOCKS, Cover, repeats
from palisade.llm.spans import flat, runs_of

MATCH_BYTES = 100
# A perfect difference set: every difference modulo 57 occurs exactly once, so 8 of 57 suffixes are sampled.
BYTE_COVER = Cover(MATCH_BYTES, 57, (0, 1, 3, 13, 32, 36, 43, 52))


def _bytes(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return flat(rows["text"])


def _kept_bytes(rows: pa.Table, data: np.ndarray, offsets: np.ndarray, removed: np.ndarray) -> pa.Table:
    gone = np.concatenate([[0], np.cumsum(removed)])
    n_removed = gone[offsets[1:]] - gone[offsets[:-1]]
    # A run that crosses into the next document counts for both: count a begin at each document's first byte anew.
    begins = removed.copy()
    begins[1:] &= ~removed[:-1]
    firsts = offsets[:-1][np.diff(offsets) > 0]
    begins[firsts] = removed[firsts]
    count = np.concatenate([[0], np.cumsum(begins)])
    sizes = np.diff(offsets)
    at = np.concatenate([[0], np.cumsum(sizes - n_removed)])
    kept = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), rows.num_rows, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data[~removed].tobytes())]
    )
    return pa.table(
        {
            "doc_id": rows["doc_id"].cast(pa.int64()),
            "n_bytes": sizes,
            "n_removed": n_removed,
            "n_spans": count[offsets[1:]] - count[offsets[:-1]],
            "kept": kept.cast(pa.binary()),
        }
    )


def removed_runs(removed: np.ndarray, lo: int, hi: int) -> list[tuple[int, int]]:
    """Maximal removed runs of one document, relative to its start."""
    starts, ends = runs_of(removed[lo:hi])
    return list(zip(starts.tolist(), ends.tolist()))


def remove_repeated_bytes(docs: DataFrame, cover: Cover = BYTE_COVER, blocks: int | None = None, wide_blocks: int = WIDE_BLOCKS) -> DataFrame:
    """Remove every byte covered by a string of `cover.length` bytes that also starts earlier.

    Earlier is a smaller id, or an earlier start in the same document; strings never cross documents. `docs`
    needs doc_id and text; other columns are left out. Returns doc_id, n_bytes, n_removed, n_spans (maximal
    removed runs) and kept (the remaining bytes, which need not be valid UTF-8), one row for each row. A null
    text is empty; null ids count as larger than all others; rows that share an id, and rows without one in
    one block, count in the order of their texts.
    """
    blocks = blocks or block_count(docs)
    dealt = docs.select(F.col("doc_id").cast("long"), "text", block_key("doc_id", "text", blocks).alias("__block"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    return repeats(dealt, _bytes, cover, bucket_bits(blocks), True, _kept_bytes, schema, wide_blocks)


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Bytes of 100-byte strings that start earlier in the corpus, removed from every text."""
    done = remove_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
