"""Substring deduplication: repeated runs of words, found through difference-cover anchors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.blocks import block_count, block_key, bucket_bits
from palisade.llm.cover import WIDE_BLOCKS, Cover, repeats
from palisade.llm.spans import flat, hash_spans, word_spans

WINDOW_WORDS = 13
# {0, 1, 3} is a difference cover modulo 7: anchors are 3 of 7 positions, 7 words long.
WORD_COVER = Cover(WINDOW_WORDS, 7, (0, 1, 3))


def _words(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = flat(rows["text"])
    starts, ends, bounds = word_spans(data, offsets)
    return hash_spans(data, starts, ends), bounds


def _kept_words(rows: pa.Table, _: np.ndarray, bounds: np.ndarray, removed: np.ndarray) -> pa.Table:
    data, offsets = flat(rows["text"])
    starts, ends, _ = word_spans(data, offsets)
    gone = np.concatenate([[0], np.cumsum(removed)])
    kept = ~removed
    # One space follows every kept word but a document's last one.
    owner = np.searchsorted(bounds, np.flatnonzero(kept), side="right") - 1
    lengths = (ends - starts)[kept]
    final = np.ones(len(owner), dtype=bool)
    final[:-1] = owner[1:] != owner[:-1]
    sizes = lengths + ~final
    out = np.full(int(sizes.sum()), 0x20, dtype=np.uint8)
    target = np.cumsum(sizes) - sizes
    inner = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(target, lengths) + inner] = data[np.repeat(starts[kept], lengths) + inner]
    per_doc = np.bincount(owner, weights=sizes, minlength=rows.num_rows).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(per_doc)])
    text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), rows.num_rows, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(out.tobytes())])
    return pa.table(
        {
            "doc_id": rows["doc_id"].cast(pa.int64()),
            "n_words": np.diff(bounds),
            "n_removed": gone[bounds[1:]] - gone[bounds[:-1]],
            "kept_text": text.cast(pa.large_string()).cast(pa.string()),
        }
    )


def remove_repeated_words(docs: DataFrame, cover: Cover = WORD_COVER, blocks: int | None = None, wide_blocks: int = WIDE_BLOCKS) -> DataFrame:
    """Remove every word covered by a window of `cover.length` words that also starts in a document with a smaller id.

    `docs` needs doc_id and text; other columns are left out. Returns doc_id, n_words, n_removed and kept_text
    (kept words joined by one space), one row for each row. A null or empty text has no words and an empty
    kept_text; a null id counts as larger than any other, and rows that share an id never remove each other's words.
    """
    blocks = blocks or block_count(docs)
    dealt = docs.select(F.col("doc_id").cast("long"), "text", block_key("doc_id", "text", blocks).alias("__block"))
    schema = "doc_id long, n_words long, n_removed long, kept_text string"
    return repeats(dealt, _words, cover, bucket_bits(blocks), False, _kept_words, schema, wide_blocks)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Words of 13-word windows that an earlier document has, removed from every text."""
    done = remove_repeated_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))
