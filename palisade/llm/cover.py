"""Exact repeats of a fixed length, found through the positions of a difference cover.

Positions whose index modulo a period lies in a difference cover are the sample. Any two equal strings of
`length` symbols hold, at the same offset below the period, a sample position in both; so equal strings are
found by comparing the sample alone, which is a small part of all positions. Three rounds between blocks
and buckets settle everything:

1. names: each sample position is named by the hash of its next `length - period + 1` symbols. Buckets of
   names are sorted one at a time; only names that occur again matter from here on.
2. ranks: a sample position whose name is shared is ranked by its context, all symbols that a string of
   `length` around it could touch. If an earlier position has the same context, every string over this one
   is a repeat. If all positions of a name have one context, there is nothing left to decide for it.
3. ties: strings over a sample position whose name has several contexts, and which no rank has settled (in
   practice those near the ends of a copy), are sorted and compared as whole strings, bucket by bucket.

A name that many blocks hold can have as many contexts as documents. Its ranks are therefore dealt by name
and context, and each block reports only its smallest and largest context to the name's own bucket: a name
has one context if all those are equal. So no bucket gathers all rows of a frequent passage.

Strings are ordered and compared by hash, not by their letters: a repeat needs equality only. Names have
32 bits within their bucket and serve as a filter; ranks compare 96 bits and ties 80.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from palisade.llm.blocks import Answers, Sent, answer, ask, bucket_bounds, ids_of, send, settle, split_keys
from palisade.llm.spans import covered, hash_spans, mix, pack, runs_of, unpack

U64 = np.uint64
# A name that at least so many blocks hold is dealt by its contexts.
WIDE_BLOCKS = 64


@dataclass(frozen=True)
class Cover:
    """A difference cover: every difference modulo the period occurs between two of the residues."""

    length: int
    period: int
    residues: tuple[int, ...]

    def __post_init__(self):
        found = {(a - b) % self.period for a in self.residues for b in self.residues}
        if len(found) != self.period or self.length < self.period:
            raise ValueError("not a difference cover for this length")

    @property
    def window(self) -> int:
        return self.length - self.period + 1

    @property
    def reach(self) -> int:
        return self.period - 1


# Takes a block's documents; returns symbols and the offsets of each document among them.
Symbols = Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]


def _low32(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The 32 bits below those that choose the bucket: they sort as the hashes do."""
    return ((hashes >> U64(32 - bits)) & U64(0xFFFFFFFF)).astype(np.uint32)


def _distinct(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and where each begins."""
    first = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, int)
    return sorted_values[first], first


class _Block:
    """One block's symbols and the sample positions among them."""

    def __init__(self, docs: pa.Table, symbols: Symbols, cover: Cover):
        self.docs, self.cover = docs, cover
        self.symbols, self.offsets = symbols(docs)
        self.ids = ids_of(docs)

    def sample(self) -> tuple[np.ndarray, np.ndarray]:
        """Sample positions that a string of the full length can hold, and their documents."""
        c, parts, owners = self.cover, [], []
        for d in np.flatnonzero(np.diff(self.offsets) >= c.length):
            lo, hi = int(self.offsets[d]), int(self.offsets[d + 1])
            last = hi - c.window - lo
            at = (np.arange(0, last + 1, c.period)[:, None] + np.array(c.residues)).reshape(-1)
            at = at[at <= last] + lo
            parts.append(at)
            owners.append(np.full(len(at), d, dtype=np.int32))
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        return np.concatenate(parts), np.concatenate(owners)

    def names(self, at: np.ndarray) -> np.ndarray:
        return hash_spans(self.symbols, at, at + self.cover.window)

    def contexts(self, at: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Hashes of all symbols a full string over the position could touch, and of how a text's end cuts them."""
        c = self.cover
        lo = np.maximum(at - c.reach, self.offsets[owner])
        hi = np.minimum(at + c.length, self.offsets[owner + 1])
        cut = (at - lo).astype(np.uint64) * U64(1 << 20) + (hi - at).astype(np.uint64)
        return hash_spans(self.symbols, lo, hi) ^ (cut * U64(0x9E3779B97F4A7C15))

    def strings(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hi = at + self.cover.length
        return hash_spans(self.symbols, at, hi), hash_spans(self.symbols, at, hi, 1).astype(np.uint16)


class _Ranked:
    """Sample positions with a shared name in the order of (name, context, position), and what is sent about them."""

    def __init__(self, block: _Block, at: np.ndarray, owner: np.ndarray):
        names, contexts = block.names(at), block.contexts(at, owner)
        order = np.lexsort((contexts, names))
        self.at, self.owner = at[order], owner[order]
        self.names, self.contexts = names[order], contexts[order]
        new_name = np.ones(len(at), dtype=bool)
        new_name[1:] = self.names[1:] != self.names[:-1]
        new_rank = new_name.copy()
        new_rank[1:] |= self.contexts[1:] != self.contexts[:-1]
        self.first = np.flatnonzero(new_rank)  # of each rank, its first position
        self.rank = np.cumsum(new_rank) - 1
        self.name = np.cumsum(new_name) - 1
        self.name_first = np.flatnonzero(new_name)
        self.ids = block.ids[self.owner]

    def entries(self, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Sorted hashes that deal the entries, what each entry stands for (a rank, or behind all ranks a name's
        report), and the arrays to send. `wide`: of each distinct name."""
        names, contexts = self.names[self.first], self.contexts[self.first]
        is_wide = wide[self.name[self.first]]
        dealt = np.where(is_wide, mix(names ^ contexts), names)
        # Contexts ascend within a name: its first and last rank are the smallest and largest.
        last = np.append(self.name_first[1:], len(self.names)) - 1
        low, high = self.contexts[self.name_first[wide]], self.contexts[last[wide]]
        own, number = self.names[self.name_first[wide]], np.flatnonzero(wide)
        two = low != high
        hashes = np.concatenate([dealt, own, own[two]])
        meaning = np.concatenate([np.arange(len(dealt)), len(dealt) + number, len(dealt) + number[two]])
        report = np.zeros(len(hashes), dtype=np.uint8)
        report[len(dealt) :] = 1
        seen = np.concatenate([contexts, low, high[two]])
        ids = np.concatenate([self.ids[self.first], np.zeros(len(hashes) - len(dealt), dtype=np.int64)])
        order = np.argsort(hashes, kind="stable")
        return hashes[order], meaning[order], report[order], [seen[order], ids[order]]


class _Tied:
    """Whole strings at the open positions in the order of (string, position)."""

    def __init__(self, block: _Block, open_: np.ndarray):
        at = np.flatnonzero(open_)
        a, b = block.strings(at)
        order = np.lexsort((b, a))
        self.at, self.a, self.b = at[order], a[order], b[order]
        self.ids = block.ids[np.searchsorted(block.offsets, self.at, side="right") - 1]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (self.a[1:] != self.a[:-1]) | (self.b[1:] != self.b[:-1])
        self.first, self.rank = np.flatnonzero(new), np.cumsum(new) - 1


def _repeats(owner_ids: np.ndarray, first: np.ndarray, rank: np.ndarray, within: bool) -> np.ndarray:
    """Which entries, sorted by rank and then position, have an earlier equal one in their own block."""
    if within:
        again = np.ones(len(rank), dtype=bool)
        again[first] = False
        return again
    return owner_ids > owner_ids[first][rank] if len(rank) else np.zeros(0, dtype=bool)


def _shared(datas: list[bytes], wide_blocks: int) -> list[np.ndarray]:
    """Round 1: which names occur more than once, and which of them many blocks hold."""
    sent = [unpack(d, np.uint32)[0] for d in datas]
    distinct = [_distinct(part)[0] for part in sent]
    everything = np.sort(np.concatenate(distinct))
    names, first = _distinct(everything)
    blocks = np.diff(np.append(first, len(everything)))
    twice = np.concatenate([part[1:][part[1:] == part[:-1]] for part in sent])
    shared = blocks > 1
    shared[np.searchsorted(names, twice)] = True
    wide = blocks >= wide_blocks
    flags = []
    for part in distinct:
        found = np.searchsorted(names, part)
        flags.append(np.column_stack([shared[found], wide[found]]).reshape(-1))
    return flags


def _judged(datas: list[bytes]) -> list[np.ndarray]:
    """Round 2: for each entry, whether an earlier document has its rank, and whether its name has another context."""
    (report, names, contexts, ids), bounds = split_keys(datas, np.uint8, np.uint32, np.uint64, np.int64)
    order = np.lexsort((ids, contexts, names, report))
    r, n, c, d = report[order], names[order], contexts[order], ids[order]
    new_name = np.ones(len(n), dtype=bool)
    new_name[1:] = (n[1:] != n[:-1]) | (r[1:] != r[:-1])
    new_rank = new_name.copy()
    new_rank[1:] |= c[1:] != c[:-1]
    firsts = np.flatnonzero(new_rank)
    earlier = d > d[firsts][np.cumsum(new_rank) - 1]
    ranks_of_name = np.add.reduceat(new_rank.astype(np.int64), np.flatnonzero(new_name))
    mixed = (ranks_of_name > 1)[np.cumsum(new_name) - 1]
    both = np.zeros((len(n), 2), dtype=bool)
    both[order, 0], both[order, 1] = earlier, mixed
    return [both[a:b].reshape(-1) for a, b in zip(bounds[:-1], bounds[1:])]


def _tied(datas: list[bytes]) -> list[np.ndarray]:
    """Round 3: which whole strings an earlier document has."""
    (a, b, ids), bounds = split_keys(datas, np.uint64, np.uint16, np.int64)
    order = np.lexsort((ids, b, a))
    x, y, d = a[order], b[order], ids[order]
    new = np.ones(len(x), dtype=bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    earlier = np.zeros(len(x), dtype=bool)
    earlier[order] = d > d[np.flatnonzero(new)][np.cumsum(new) - 1]
    return [earlier[lo:hi] for lo, hi in zip(bounds[:-1], bounds[1:])]


def _counts(sorted_hashes: np.ndarray, bits: int) -> np.ndarray:
    return np.diff(bucket_bounds(sorted_hashes, bits))


def repeats(
    docs: DataFrame, symbols: Symbols, cover: Cover, bits: int, within: bool, finish: Callable, schema: str, wide_blocks: int = WIDE_BLOCKS
) -> DataFrame:
    """Rows of `finish(docs, symbols, offsets, removed)` for every block of `docs` (__block, doc_id, text).

    `removed` flags each symbol inside a string of `cover.length` that also starts earlier: in a document
    with a smaller id or, if `within`, also earlier in the same document. Null ids count as the largest.
    """

    def names(rows: pa.Table, _: Answers, __: int) -> Sent:
        block = _Block(rows, symbols, cover)
        found = np.sort(block.names(block.sample()[0]))
        # A name is sent twice if the block holds it more than once: then it is shared whatever others hold.
        third = np.zeros(len(found), dtype=bool)
        third[2:] = (found[2:] == found[1:-1]) & (found[1:-1] == found[:-2])
        found = found[~third]
        return send(found, bits, [_low32(found, bits)])

    def ranks(rows: pa.Table, answers: Answers, own: int) -> Sent:
        block = _Block(rows, symbols, cover)
        at, owner = block.sample()
        found = block.names(at)
        # Equal low bits in one bucket count once, as they did in round 1.
        distinct = _distinct(np.sort(found))[0]
        low = _low32(distinct, bits)
        bucket = distinct >> U64(64 - bits) if bits else np.zeros(len(distinct), np.uint64)
        kept = np.ones(len(distinct), dtype=bool)
        kept[1:] = (low[1:] != low[:-1]) | (bucket[1:] != bucket[:-1])
        flags = answers.flags(2 * _counts(distinct[kept], bits)).reshape(-1, 2)[np.cumsum(kept) - 1]
        shared, wide = distinct[flags[:, 0]], flags[flags[:, 0], 1]
        if len(shared):
            member = shared[np.minimum(np.searchsorted(shared, found), len(shared) - 1)] == found
        else:
            member = np.zeros(len(found), dtype=bool)
        ranked = _Ranked(block, at[member], owner[member])
        yield own, pack(np.packbits(member), np.packbits(wide))
        hashes, _, report, (contexts, ids) = ranked.entries(wide)
        yield from send(hashes, bits, [report, _low32(hashes, bits), contexts, ids])

    def ties(rows: pa.Table, answers: Answers, own: int) -> Sent:
        block = _Block(rows, symbols, cover)
        at, owner = block.sample()
        member, wide = unpack(answers.state, np.uint8, np.uint8)
        member = np.unpackbits(member, count=len(at)).astype(bool)
        ranked = _Ranked(block, at[member], owner[member])
        wide = np.unpackbits(wide, count=len(ranked.name_first)).astype(bool)
        hashes, meaning, report, _ = ranked.entries(wide)
        both = answers.flags(2 * _counts(hashes, bits)).reshape(-1, 2)
        ranks = len(ranked.first)
        of_rank = np.zeros((ranks, 2), dtype=bool)
        of_rank[meaning[report == 0]] = both[report == 0]
        of_name = np.zeros(len(ranked.name_first), dtype=bool)
        of_name[meaning[report == 1] - ranks] = both[report == 1, 1]
        settled = of_rank[ranked.rank, 0] | _repeats(ranked.ids, ranked.first, ranked.rank, within)
        mixed = of_rank[ranked.rank, 1] | of_name[ranked.name]
        size = len(block.symbols)

        def strings_over(chosen: np.ndarray) -> np.ndarray:
            q, d = ranked.at[chosen], ranked.owner[chosen]
            lo = np.maximum(q - cover.reach, block.offsets[d])
            return covered(size, lo, np.minimum(q, block.offsets[d + 1] - cover.length) + 1)

        done = strings_over(settled)
        open_ = strings_over(mixed) & ~done
        tied = _Tied(block, open_)
        yield own, pack(*(x.astype(np.uint32) for pair in (runs_of(done), runs_of(open_)) for x in pair))
        yield from send(tied.a[tied.first], bits, [tied.a[tied.first], tied.b[tied.first], tied.ids[tied.first]])

    def last(rows: pa.Table, answers: Answers) -> pa.Table:
        block = _Block(rows, symbols, cover)
        size = len(block.symbols)
        starts, ends, *open_runs = (x.astype(np.int64) for x in unpack(answers.state, *[np.uint32] * 4))
        tied = _Tied(block, covered(size, *open_runs))
        repeat = _repeats(tied.ids, tied.first, tied.rank, within)
        if len(tied.rank):
            repeat |= answers.flags(_counts(tied.a[tied.first], bits))[tied.rank]
        lo = np.concatenate([starts, tied.at[repeat]])
        hi = np.concatenate([ends, tied.at[repeat] + 1]) + cover.length - 1
        return finish(rows, block.symbols, block.offsets, covered(size, lo, hi))

    asked = answer(ask(docs, None, bits, names), bits, lambda datas: _shared(datas, wide_blocks))
    ranked = answer(ask(docs, asked, bits, ranks), bits, _judged)
    tied = answer(ask(docs, ranked, bits, ties), bits, _tied)
    return settle(docs, tied, bits, last, schema)
