"""Near-duplicate detection: SetSketch registers, banded, compared by likelihood, and verified on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.blocks import Answers, answer, ask, block_count, block_key, bucket_bits, bucket_bounds, send, settle
from palisade.llm.spans import LOWER, batches, flat, hash_spans, mix, unpack, word_spans
from palisade.llm.vectors import attach
from palisade.session import materialize

SHINGLE_WORDS = 5
SLICE_BYTES = 2 << 20


@dataclass(frozen=True)
class Sketch:
    """Registers are floor(1 - log_base(minimum)) of exponentially distributed minima, cut to 16 bits.

    Sketches of two sets merge by the larger register. With a base close to 1 two registers are equal about as
    often as the sets' similarity; `rows` registers make a band, and sets that agree in one of `bands` bands
    are compared. At similarity 0.75 a pair is missed once in 200,000 with 32 bands of 4.
    """

    bands: int = 32
    rows: int = 4
    base: float = 1.001
    seed: int = 7

    @property
    def registers(self) -> int:
        return self.bands * self.rows

    def of_sets(self, shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One row of registers for each non-empty set; `starts` begin the sets among the shingle hashes."""
        short = (shingles >> np.uint64(32)).astype(np.uint32)
        rng = np.random.default_rng(self.seed)
        out = np.empty((len(starts), self.registers), dtype=np.uint16)
        work = np.empty_like(short)
        for j in range(self.registers):
            odd, add = rng.integers(0, 2**31, 2)
            np.multiply(short, np.uint32(2 * int(odd) + 1), out=work)
            np.add(work, np.uint32(int(add) * 2 + 1), out=work)
            np.bitwise_xor(work, work >> np.uint32(15), out=work)
            np.multiply(work, np.uint32(0x2C1B3C6D), out=work)
            least = np.minimum.reduceat(work, starts).astype(np.float64)
            minimum = -np.log1p(-(least + 0.5) / 2.0**32)
            level = np.floor(1 - np.log(minimum) / np.log(self.base))
            out[:, j] = np.clip(level, 0, 65535)
        return out

    def band_keys(self, registers: np.ndarray) -> np.ndarray:
        """One 64-bit key for each set and band."""
        words = np.ascontiguousarray(registers.reshape(len(registers), self.bands, self.rows)).astype(np.uint64)
        key = np.zeros(words.shape[:2], dtype=np.uint64)
        for j in range(self.rows):
            key = mix(key ^ (words[:, :, j] + np.uint64(0x9E3779B97F4A7C15)))
        return mix(key + np.arange(self.bands, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))

    def unlikely(self, more: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, similarity: float) -> np.ndarray:
        """Pairs whose registers all but rule out the similarity; `more` and `less` count larger and smaller registers.

        These numbers are multinomial, with chances that follow from the similarity and the two known set
        sizes. A pair is ruled out if some lower similarity is e^10 times as likely as the one asked for, which
        befalls a pair of that similarity less than once in 200,000.
        """
        same = self.registers - more - less
        u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
        largest = np.minimum(u / v, v / u)

        def chance(x):
            x = np.clip(x, 0.0, 1.0)
            return -np.log1p(-x * (self.base - 1) / self.base) / np.log(self.base)

        def likelihood(j):
            j = np.minimum(j, largest)
            p, q = chance(u - v * j), chance(v - u * j)
            e = np.maximum(1 - p - q, 1e-12)
            return more * np.log(np.maximum(p, 1e-12)) + less * np.log(np.maximum(q, 1e-12)) + same * np.log(e)

        asked = likelihood(np.full(len(u), similarity))
        best = np.max([likelihood(np.full(len(u), j)) for j in np.linspace(0, similarity, 31)], axis=0)
        return (best - asked > 10) | (largest < similarity - 1e-9)


def shingle_sets(texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, and where each text's begin."""
    data, offsets = flat(texts)
    data = LOWER[data]
    starts, ends, bounds = word_spans(data, offsets)
    words = hash_spans(data, starts, ends)
    counts = np.diff(bounds)
    size = np.minimum(counts, SHINGLE_WORDS)  # fewer words make one shingle of them all
    n = np.where(counts > 0, counts - size + 1, 0)
    doc = np.repeat(np.arange(len(counts)), n)
    lo = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + bounds[:-1][doc]
    hashes = hash_spans(words, lo, lo + size[doc])
    order = np.lexsort((hashes, doc))
    hashes = hashes[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], np.searchsorted(doc[new], np.arange(len(counts) + 1))


def signatures(docs: DataFrame, sketch: Sketch) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (a 128-bit hash of the set; null if empty) and registers of each row."""

    def sign(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            for part in batches(pa.Table.from_batches([table]), SLICE_BYTES, "text"):
                shingles, bounds = shingle_sets(part["text"])
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                starts = bounds[:-1][full]
                keys = [np.zeros(len(n), dtype=np.uint64) for _ in range(2)]
                registers: list[bytes | None] = [None] * len(n)
                if len(full):
                    for i, salt in enumerate((0x9AE16A3B2F90404F, 0xC949D7C7509E6557)):
                        keys[i][full] = np.add.reduceat(mix(shingles ^ np.uint64(salt)), starts)
                    for i, row in zip(full, sketch.of_sets(shingles, starts)):
                        registers[i] = row.tobytes()
                empty = n == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        part["doc_id"].combine_chunks().cast(pa.int64()),
                        pa.array(n.astype(np.int64)),
                        pa.array(keys[0].view(np.int64), mask=empty),
                        pa.array(keys[1].view(np.int64), mask=empty),
                        pa.array(registers, pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "set_a", "set_b", "registers"],
                )

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n_shingles long, set_a long, set_b long, registers binary")


def _bands(classes: DataFrame, sketch: Sketch) -> DataFrame:
    def keys(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            if table.num_rows:
                registers = np.frombuffer(b"".join(table["registers"].to_pylist()), np.uint16).reshape(table.num_rows, -1)
                band = sketch.band_keys(registers)
                rep = np.repeat(table["rep"].to_numpy(zero_copy_only=False), sketch.bands)
                yield pa.RecordBatch.from_arrays([pa.array(band.reshape(-1).view(np.int64)), pa.array(rep)], ["band", "rep"])

    return classes.select("rep", "registers").mapInArrow(keys, "band long, rep long")


def _likely(pairs: DataFrame, classes: DataFrame, sketch: Sketch, similarity: float) -> DataFrame:
    """Pairs (a, b) whose registers do not rule the similarity out."""

    def judge(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            if table.num_rows == 0:
                continue
            a, b = (np.frombuffer(b"".join(table[c].to_pylist()), np.uint16).reshape(table.num_rows, -1) for c in ("registers_a", "registers_b"))
            n_a, n_b = (table[c].to_numpy(zero_copy_only=False).astype(float) for c in ("n_a", "n_b"))
            kept = ~sketch.unlikely((a > b).sum(axis=1), (a < b).sum(axis=1), n_a, n_b, similarity)
            yield table.select(["a", "b"]).filter(pa.array(kept))

    # Pairs grow with the corpus: merge joins, so that they are never sent to all tasks.
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("registers").alias(f"registers_{x}")).hint("merge")
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return joined.select("a", "b", "n_a", "n_b", "registers_a", "registers_b").mapInArrow(judge, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union on their full shingle sets."""

    def verify(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            for part in batches(pa.Table.from_batches([table]), SLICE_BYTES, "text_a"):
                (x, x_at), (y, y_at) = shingle_sets(part["text_a"]), shingle_sets(part["text_b"])
                kept = np.zeros(part.num_rows, dtype=bool)
                for i in range(part.num_rows):
                    p, q = x[x_at[i] : x_at[i + 1]], y[y_at[i] : y_at[i + 1]]
                    both = np.sort(np.concatenate([p, q]))
                    shared = int((both[1:] == both[:-1]).sum())
                    kept[i] = 100 * shared >= percent * (len(p) + len(q) - shared)
                yield from part.select(["a", "b"]).filter(pa.array(kept)).to_batches()

    side = lambda x: texts.select(F.col("rep").alias(x), F.col("text").alias(f"text_{x}")).hint("merge")
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(verify, "a long, b long")


def components(links: DataFrame, label: str = "near") -> DataFrame:
    """(node, component): the smallest node reachable over the links (a, b); nodes without links are left out.

    Alternating star contraction: each round hangs a node's larger neighbours, then its smaller ones, on the
    smallest of them, and writes the links; it ends when all links lead to a smallest node. Rounds grow with
    the logarithm of the longest chain.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), f"{label}-links")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = materialize(small.distinct(), f"{label}-links")
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return materialize(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots), f"{label}-components")


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one link at most, to a node that has none."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.filter("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def _unsettled(named: DataFrame) -> DataFrame:
    """Rows (band, component and others) of the buckets that hold several components."""
    spread = named.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("members"))
    return named.drop("members").join(spread.filter("low <> high").select("band", "members"), "band")


def _shared_counts(texts: DataFrame) -> DataFrame:
    """(rep, n, known): shingles of each text, and those that another of the texts holds too."""
    blocks = block_count(texts)
    bits = bucket_bits(blocks)
    dealt = texts.select(F.col("rep").alias("doc_id"), "text").withColumn("__block", block_key("doc_id", "text", blocks))

    def distinct(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        shingles, bounds = shingle_sets(rows["text"])
        order = np.argsort(shingles, kind="stable")
        ranked = shingles[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, dtype=bool)
        return ranked[new], np.diff(np.append(np.flatnonzero(new), len(ranked))), order, np.cumsum(new) - 1

    def low32(hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)

    def ask_block(rows: pa.Table, _, __) -> Iterator[tuple[int, bytes]]:
        hashes = distinct(rows)[0]
        yield from send(hashes, bits, [low32(hashes)])

    def several(datas: list[bytes]) -> list[np.ndarray]:
        parts = [unpack(d, np.uint32)[0] for d in datas]
        ranked = np.sort(np.concatenate(parts))
        again = ranked[1:][ranked[1:] == ranked[:-1]]
        if len(again) == 0:
            return [np.zeros(len(p), dtype=bool) for p in parts]
        return [again[np.minimum(np.searchsorted(again, p), len(again) - 1)] == p for p in parts]

    def count(rows: pa.Table, answers: Answers) -> pa.Table:
        hashes, times, order, rank = distinct(rows)
        known = answers.flags(np.diff(bucket_bounds(hashes, bits))) | (times > 1)
        flags = np.zeros(len(order), dtype=np.int64)
        flags[order] = known[rank]
        bounds = shingle_sets(rows["text"])[1]
        total = np.concatenate([[0], np.cumsum(flags)])
        return pa.table({"rep": rows["doc_id"], "n": np.diff(bounds), "known": total[bounds[1:]] - total[bounds[:-1]]})

    answered = answer(ask(dealt, None, bits, ask_block), bits, several)
    counted = settle(dealt, answered, bits, count, "rep long, n long, known long")
    # Of rows that share an id the largest numbers hold: they only loosen a bound.
    return counted.groupBy("rep").agg(F.max("n").alias("n"), F.max("known").alias("known"), F.min("n").alias("least_n"))


FINE = Sketch(bands=256, rows=4)
MEMBERS = 1024


def _second_round(rest: DataFrame, texts: DataFrame, classes: DataFrame, sketch: Sketch, percent: int) -> DataFrame:
    """Verified links between different components of the buckets `rest` (band, rep, first, component, members).

    A shingle that no other text in question holds cannot be shared, so known shingles bound the similarity of a
    text to any other, and of a pair. What the bound leaves is compared by sketches with eight times the
    registers: buckets are cut into parts of about `MEMBERS` rows, two parts meet in a task, and only pairs
    that their registers do not rule out come out of it, each from the first bucket it shares, to be verified
    on their full sets.
    """
    counts = materialize(_shared_counts(texts), "near-counts")
    able = counts.filter(100 * F.col("known") >= percent * F.col("least_n"))
    bounded = materialize(_unsettled(rest.join(able, "rep")), "near-bounded")

    def sign(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            for part in batches(pa.Table.from_batches([table]), SLICE_BYTES, "text"):
                shingles, bounds = shingle_sets(part["text"])
                full = np.flatnonzero(np.diff(bounds))
                if len(full):
                    fine = [row.tobytes() for row in FINE.of_sets(shingles, bounds[:-1][full])]
                    yield pa.RecordBatch.from_arrays([part["rep"].take(pa.array(full)).combine_chunks(), pa.array(fine, pa.binary())], ["rep", "fine"])

    signed = texts.join(bounded.select("rep").distinct(), "rep", "left_semi").select("rep", "text").mapInArrow(sign, "rep long, fine binary")
    parts = F.ceil(F.col("members") / MEMBERS).cast("int")
    own = F.pmod(F.xxhash64("rep"), parts).cast("int")
    met = F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("low"), F.greatest(k, F.col("own")).alias("high")))
    coarse = classes.select("rep", "registers")
    rows = bounded.join(signed.hint("merge"), "rep").join(coarse.hint("merge"), "rep").withColumn("own", own).withColumn("met", F.explode(met)).select("*", "met.low", "met.high").drop("met", "members")

    def meet(table: pa.Table) -> pa.Table:
        low, high, band = table["low"][0].as_py(), table["high"][0].as_py(), np.int64(table["band"][0].as_py()).view(np.uint64)
        keys = sketch.band_keys(np.frombuffer(b"".join(table["registers"].to_pylist()), np.uint16).reshape(table.num_rows, -1))
        registers = np.frombuffer(b"".join(table["fine"].to_pylist()), np.uint16).reshape(table.num_rows, -1)
        rep, first, component, n, known, side = (table[c].to_numpy() for c in ("rep", "first", "component", "n", "known", "own"))
        found = [(rep[:0], rep[:0])]
        for i in np.flatnonzero(side == low):
            least = np.minimum(known, known[i])
            fits = (component != component[i]) & (100 * least >= percent * (n + n[i] - least)) & (rep != first) & (rep[i] != first)
            if low == high:
                fits &= np.arange(len(rep)) > i
            else:
                fits &= side == high
            j = np.flatnonzero(fits)
            # Two texts that share several buckets meet in all of them, and are compared in the first.
            common = keys[j] == keys[i]
            j = j[keys[i][common.argmax(axis=1)] == band] if len(j) else j
            if len(j):
                more, less = (registers[i] > registers[j]).sum(axis=1), (registers[i] < registers[j]).sum(axis=1)
                j = j[~FINE.unlikely(more, less, np.full(len(j), float(n[i])), n[j].astype(float), percent / 100)]
                found.append((np.full(len(j), rep[i]), rep[j]))
        a, b = (np.concatenate(x) for x in zip(*found))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    pairs = rows.groupBy("band", "low", "high").applyInArrow(meet, "a long, b long").distinct()
    return materialize(_verified(materialize(pairs, "near-pairs"), texts, percent).distinct(), "near-verified")


def near_duplicates(docs: DataFrame, percent: int = 75, sketch: Sketch = Sketch()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of `docs` (doc_id, text; other columns are left out).

    Documents whose distinct five-word shingles have 100 * intersection >= percent * union are linked; a
    component is named by its smallest id, and that document is kept. Documents with equal sets are one class
    and need no comparison. A text without words has no shingles and no links, and rows that share an id are
    one document. A row without an id takes its class's component; without one it stays alone (component_id
    null) and is kept.
    """
    similarity = percent / 100
    signed = materialize(signatures(docs, sketch), "near-signatures")
    full = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    sets = signed.filter("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    sets = materialize(sets.filter("rep IS NOT NULL"), "near-sets")
    members = sets.drop("n")
    classes = materialize(
        # Joined by id as well: a class with a third of all rows must not meet in one task.
        full.join(members.withColumn("doc_id", F.col("rep")), ["doc_id", "set_a", "set_b"]).select("rep", "n_shingles", "registers").distinct(),
        "near-classes",
    )
    bands = _bands(classes, sketch)
    sizes = bands.groupBy("band").agg(F.min("rep").alias("first"), F.count(F.lit(1)).alias("n"))
    shared = materialize(bands.join(sizes.filter("n > 1"), "band").select("band", "rep", "first"), "near-bands")

    def compare(pairs: DataFrame) -> DataFrame:
        likely = materialize(_likely(pairs.filter("a <> b").distinct(), classes, sketch, similarity), "near-likely")
        ends = likely.select(F.col("a").alias("doc_id")).unionByName(likely.select(F.col("b").alias("doc_id"))).distinct()
        # Of rows that share an id and stand for one class the texts have one set each; one of them is enough.
        texts = docs.select(F.col("doc_id").cast("long"), "text").join(ends.hint("merge"), "doc_id").select(F.col("doc_id").alias("rep"), "text")
        return materialize(_verified(likely, texts, percent).distinct(), "near-verified")

    # Round 1: every class against the smallest of each of its buckets. Most buckets are one component after it.
    links = compare(shared.select(F.col("rep").alias("a"), F.col("first").alias("b")))
    several = full.select("doc_id", "set_a", "set_b").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    same_id = full.select("doc_id", "set_a", "set_b").join(several, "doc_id").join(members, ["set_a", "set_b"]).filter("doc_id <> rep")
    found = components(links.unionByName(same_id.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))))

    # Round 2: in buckets that still hold several components, every pair that no link has brought together yet.
    named = shared.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    rest = materialize(_unsettled(named), "near-unsettled")
    if not rest.isEmpty():
        texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(rest.select("rep").distinct().hint("merge"), "rep")
        more = _second_round(rest, materialize(texts, "near-texts"), classes, sketch, percent)
        if not more.isEmpty():
            # The new links join whole components: only those are contracted again.
            ends = found.withColumnRenamed("component", "to")
            joined = more
            for side in ("a", "b"):
                joined = joined.join(ends.withColumnRenamed("node", side), side, "left").withColumn(side, F.coalesce("to", side)).drop("to")
            merged = components(joined)
            moved = merged.select(F.col("node").alias("component"), F.col("component").alias("to"))
            known = found.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
            # A component of one class has no row of its own yet.
            found = materialize(known.unionByName(merged.join(known, "node", "left_anti")), "near-components")

    # A set that a third of all rows have must not draw them into one task, nor must the rows without any set.
    named = sets.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("set_a", "set_b", "n", F.coalesce("component", "rep").alias("component"))
    worded = attach(signed.filter("n_shingles > 0").drop("registers"), named, ["set_a", "set_b"])
    empty = signed.filter("n_shingles = 0").drop("registers").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    out = worded.unionByName(empty)
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op5_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents at a similarity of 0.75 on five-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
