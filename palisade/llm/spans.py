"""Vectorised text helpers used inside tasks: spans of words and lines, hashes of spans, packed arrays.

Texts stay in Arrow's own byte buffer; a span is a pair of offsets into it. Hashes are polynomials over the
span's symbols modulo 2^64, computed from prefix sums in pieces of bounded size, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
PIECE = 1 << 20
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_MULTIPLIERS = (0x5851F42D4C957F2D, 0xD1342543DE82EF95)
_tables: dict = {}


def byte_values() -> np.ndarray:
    """A fixed random 64-bit value for each byte."""
    if "bytes" not in _tables:
        _tables["bytes"] = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
    return _tables["bytes"]


def _powers(family: int) -> tuple[np.ndarray, np.ndarray]:
    if family not in _tables:
        factor = _MULTIPLIERS[family]
        both = []
        for r in (factor, pow(factor, -1, 2**64)):
            steps = np.full(PIECE + 1, U64(r), dtype=np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps))
        _tables[family] = tuple(both)
    return _tables[family]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole word (a finaliser of the murmur family)."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def hash_spans(symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray, family: int = 0) -> np.ndarray:
    """64-bit hashes of symbols[lo:hi]; both bounds must ascend. Byte symbols get random values first."""
    power, inverse = _powers(family)
    values = byte_values() if symbols.dtype == np.uint8 else None
    out = np.empty(len(lo), dtype=np.uint64)

    def prefix(base: int, end: int) -> np.ndarray:
        piece = symbols[base:end]
        piece = (values[piece] if values is not None else piece) * power[: end - base]
        sums = np.zeros(end - base + 1, dtype=np.uint64)
        np.cumsum(piece, out=sums[1:])
        return sums

    i = 0
    while i < len(lo):
        base = int(lo[i])
        j = int(np.searchsorted(hi, base + PIECE, side="right"))
        if j <= i:  # one span longer than a piece: fold the hashes of its pieces
            folded = 0
            for start in range(base, int(hi[i]), PIECE):
                part = int(prefix(start, min(start + PIECE, int(hi[i])))[-1])
                folded = (folded * 0x9E3779B97F4A7C15 + part + 1) % 2**64
            out[i] = folded
            i += 1
            continue
        sums = prefix(base, int(hi[j - 1]))
        left = lo[i:j] - base
        out[i:j] = (sums[hi[i:j] - base] - sums[left]) * inverse[left]
        i = j
    return mix(out ^ ((hi - lo).astype(np.uint64) * U64(0x9E3779B97F4A7C15)))


def flat(texts) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts behind each other, and the offsets of each text; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words (maximal runs of bytes that do not separate), and words before each text."""
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = ~apart[data]
    begins = inside[1:] & ~inside[:-1]  # index i: a word begins at byte i
    ends = inside[:-1] & ~inside[1:]  # index i: a word ends before byte i
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    crossed = edges[inside[edges] & inside[edges + 1]]
    begins[crossed] = True
    ends[crossed] = True
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends)
    return starts, stops, np.searchsorted(starts, offsets)


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true flags."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def covered(length: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Flags of the positions inside any of the ranges lo..hi (end exclusive)."""
    steps = np.bincount(lo, minlength=length + 1)
    steps -= np.bincount(hi, minlength=length + 1)
    return np.cumsum(steps[:-1]) > 0


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one binary value, bytes of equal weight together so that compression works."""
    parts = [np.array([len(arrays), *(len(a) for a in arrays)], dtype="<i8").tobytes()]
    for a in arrays:
        wide = np.ascontiguousarray(a)
        parts.append(wide.view(np.uint8).reshape(len(wide), -1).T.tobytes() if len(wide) else b"")
    return b"".join(parts)


def unpack(data: bytes, *kinds) -> list[np.ndarray]:
    sizes = np.frombuffer(data, "<i8", len(kinds) + 1)[1:]
    at, out = 8 * (len(kinds) + 1), []
    for size, kind in zip(sizes, kinds):
        kind = np.dtype(kind)
        raw = np.frombuffer(data, np.uint8, int(size) * kind.itemsize, at)
        out.append(np.ascontiguousarray(raw.reshape(kind.itemsize, int(size)).T).reshape(-1).view(kind))
        at += int(size) * kind.itemsize
    return out


def batches(table: pa.Table, most_bytes: int, column: str) -> Iterator[pa.Table]:
    """Slices of a table that hold about that many bytes of a text column, one row at least."""
    sizes = pc.fill_null(pc.binary_length(table[column]), 0).to_numpy(zero_copy_only=False)
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        before = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + most_bytes, side="right")))
        yield table.slice(at, to - at)
        at = to
