"""Language identification with one bit-sliced Bloom filter that holds the n-grams of all languages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.llm.runtime import hide_columns
from palisade.llm.spans import LOWER, batches, flat, mix

GRAM = 4
ROWS_LOG2 = 20
PROBES = 3
SLICE_BYTES = 1 << 20
UNDETERMINED = "und"
_LETTERS = LOWER.copy()
_LETTERS[:0x41] = 0x20
_LETTERS[0x5B:0x61] = 0x20
_LETTERS[0x7B:0x80] = 0x20


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """Whether the checksum of the id as text leaves the remainder; a row without an id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def _grams(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """4-byte n-grams of each text in lower case with everything but letters blanked, and where each text's begin."""
    padded = pc.binary_join_element_wise(" ", pc.fill_null(texts, ""), "  ", "")
    data, offsets = flat(padded)
    data = _LETTERS[data].astype(np.uint32)
    if len(data) < GRAM:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    grams = (data[:-3] << np.uint32(24)) | (data[1:-2] << np.uint32(16)) | (data[2:-1] << np.uint32(8)) | data[3:]
    use = grams != 0x20202020
    # Every text ends with padding of three bytes, so no n-gram that begins before its last three crosses into the next.
    ends = offsets[1:, None] - np.arange(1, GRAM)
    use[ends[(ends >= 0) & (ends < len(grams))]] = False
    at = np.flatnonzero(use)
    return grams[at], at, np.searchsorted(at, offsets)


def _probes(grams: np.ndarray) -> list[np.ndarray]:
    h = mix(grams.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    return [((h >> np.uint64(ROWS_LOG2 * i)) & np.uint64((1 << ROWS_LOG2) - 1)).astype(np.int64) for i in range(PROBES)]


@dataclass(frozen=True)
class LanguageFilter:
    """Row r of `bits` holds one bit for each language that has an n-gram with a probe at r (64 languages a word)."""

    languages: tuple[str, ...]
    bits: np.ndarray  # 2^20 rows x words, unsigned 64-bit: its size depends on the number of languages only
    fill: np.ndarray  # share of rows with the language's bit
    usual: int  # the language with most training text

    def scores(self, grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """For each text and language: n-grams the language holds, less those that a filter this full holds by chance."""
        found = None
        for at in _probes(grams):
            found = self.bits[at] if found is None else found & self.bits[at]
        n = np.diff(bounds)
        out = np.zeros((len(n), len(self.languages)))
        for k in range(len(self.languages)):
            hit = (found[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)
            total = np.concatenate([[0], np.cumsum(hit)])
            chance = self.fill[k] ** PROBES
            out[:, k] = np.maximum(0.0, (total[bounds[1:]] - total[bounds[:-1]] - n * chance) / (1 - chance if chance < 1 else 1))
        return out


def fit(docs: DataFrame, least_share: float = 1e-6, lead: float = 0.3) -> LanguageFilter:
    """Learn from the texts and languages of `docs` (text, lang); rows without either are left out.

    An n-gram belongs to a language if it makes up at least `least_share` of the language's n-grams and at
    least `lead` of its share in the language where it is most common. Counts cover all rows.
    """
    spark = docs.sparkSession

    def count(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        keys, sums = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for table in tables:
            for part in batches(pa.Table.from_batches([table]), SLICE_BYTES, "text"):
                grams, _, bounds = _grams(part["text"])
                lang = np.array([names.setdefault(x, len(names)) for x in part["lang"].to_pylist()], dtype=np.uint64)
                found = np.sort((np.repeat(lang, np.diff(bounds)) << np.uint64(32)) | grams)
                first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, np.int64)
                keys = np.concatenate([keys, found[first]])
                sums = np.concatenate([sums, np.diff(np.append(first, len(found)))])
                order = np.argsort(keys, kind="stable")
                keys, sums = keys[order], sums[order]
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
                keys, sums = keys[first], np.add.reduceat(sums, first) if len(first) else sums[:0]
        by_code = list(names)
        lang = pa.array([by_code[i] for i in (keys >> np.uint64(32)).tolist()], pa.string())
        yield pa.RecordBatch.from_arrays([lang, pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(sums)], ["lang", "gram", "n"])

    known = docs.select("text", "lang").filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = known.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    sizes = {r.lang: r.total for r in totals.collect()}
    if not sizes:
        return LanguageFilter((), np.zeros((1 << ROWS_LOG2, 0), dtype=np.uint64), np.zeros(0), 0)
    languages = tuple(sorted(sizes))
    share = F.col("n") / F.element_at(F.create_map(*[F.lit(x) for k in languages for x in (k, float(sizes[k]))]), F.col("lang"))
    code = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(languages) for x in (k, i)]), F.col("lang"))
    shares = counts.withColumn("share", share).withColumn("code", code)
    kept = (
        shares.groupBy("gram")
        .agg(F.max("share").alias("most"), F.collect_list(F.struct("code", "share")).alias("in"))
        .select("gram", F.explode(F.filter("in", lambda x: (x.share >= least_share) & (x.share >= lead * F.col("most")))).alias("x"))
        .select("gram", F.col("x.code").alias("code"))
    )

    def probes(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            grams = table["gram"].to_numpy(zero_copy_only=False).astype(np.uint32)
            code = table["code"].to_numpy(zero_copy_only=False).astype(np.int64)
            rows = np.concatenate(_probes(grams))
            code = np.tile(code, PROBES)
            mask = np.uint64(1) << (code % 64).astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(code // 64), pa.array(mask.view(np.int64))], ["row", "word", "mask"])

    # At most 2^20 rows for each 64 languages come back, whatever the size of the corpus.
    set_rows = kept.mapInArrow(probes, "row long, word long, mask long").groupBy("row", "word").agg(F.bit_or("mask").alias("mask"))
    table = set_rows.toArrow()
    bits = np.zeros((1 << ROWS_LOG2, -(-len(languages) // 64)), dtype=np.uint64)
    bits[table["row"].to_numpy(), table["word"].to_numpy()] = table["mask"].to_numpy().view(np.uint64)
    fill = np.array([float(((bits[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean()) for k in range(len(languages))])
    return LanguageFilter(languages, bits, fill, int(np.argmax([sizes[k] for k in languages])))


def predict(docs: DataFrame, model: LanguageFilter, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of `docs` and two more: the predicted language and a score from 0 to 1.

    The score is the winner's share of the corrected counts of all languages. A text that is null or has no
    letter gets `und` and 0.0; one with letters but no known n-gram gets the most usual language and 0.0;
    ties go to the language that sorts first. A model learned from no text says `und` of all. Columns of `docs` with the two names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs, back = hide_columns(docs.drop(pred, score), "__letter")
    schema = T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    docs = docs.withColumn("__letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))

    def judge(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = sent.value
        names = np.array([*filters.languages, UNDETERMINED], dtype=object)
        for table in tables:
            for part in batches(pa.Table.from_batches([table]), SLICE_BYTES, "text"):
                grams, _, bounds = _grams(part["text"])
                scores = filters.scores(grams, bounds) if filters.languages else np.zeros((part.num_rows, 1))
                best, total = scores.argmax(axis=1), scores.sum(axis=1)
                best[total == 0] = filters.usual
                share = np.divide(scores.max(axis=1), total, out=np.zeros(len(total)), where=total > 0)
                letter = part["__letter"].to_numpy(zero_copy_only=False).astype(bool)
                best[~letter], share[~letter] = len(names) - 1, 0.0
                out = part.drop_columns(["__letter"])
                out = out.append_column(pred, pa.array(names[best], pa.string())).append_column(score, pa.array(share))
                yield from out.to_batches()

    return docs.mapInArrow(judge, schema).withColumnsRenamed(back)


def keep_identified(docs: DataFrame, model: LanguageFilter, above_chance: bool = False) -> DataFrame:
    """Rows of `docs` whose text has a language; columns as they were.

    A text without a letter goes. With `above_chance` one whose score is 0 goes too: no language holds more of its
    n-grams than a filter as full as the language's holds by chance. A model learned from no text judges letters only.
    """
    if not model.languages:
        return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    docs, back = hide_columns(docs, "__pred", "__score")
    judged = predict(docs, model, "__pred", "__score")
    found = F.col("__pred") != UNDETERMINED
    return judged.filter(found & (F.col("__score") > 0) if above_chance else found).select(*docs.columns).withColumnsRenamed(back)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the documents that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = held_out("doc_id", 4, 2)
    model = fit(docs.filter(~out).select("text", "lang"))
    judged = predict(docs.select("doc_id", out.alias("held_out"), "text"), model)
    return judged.select(F.col("doc_id").cast("long"), "held_out", "lang_pred", "score")
