"""Mixing sources to target weights by capped water-filling, with DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.segments import row_numbers, running
from palisade.session import materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _source_key(source: str) -> Column:
    """Sorts as the sources do by code point, with null behind all of them."""
    return F.when(F.col(source).isNull(), F.lit("t")).otherwise(F.concat(F.lit("s"), F.col(source)))


def water_fill(sources: DataFrame, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Adds `target` to sources (size, weight; a written table): weight times a common level, at most epochs * size.

    The level starts at share * all sizes by weight. Sources above their cap are clamped to it and what they
    leave is reshared among the others by weight, until no further source is above. Each round reads three
    sums over the sources; the level only rises, so there are at most as many rounds as sources.
    """
    cap = F.col("size") * epochs
    total = sources.agg(F.sum("size"), F.sum("weight")).first()
    budget, level, clamped = share * (total[0] or 0), 0.0, -1
    if total[1]:
        level = budget / total[1]
    while True:
        above = cap < F.lit(level) * F.col("weight")
        seen = sources.agg(
            F.count_if(above), F.sum(F.when(above, cap).otherwise(0)), F.sum(F.when(~above, F.col("weight")).otherwise(0))
        ).first()
        if seen[0] == clamped or not seen[2]:
            break
        clamped, level = seen[0], (budget - seen[1]) / seen[2]
    return sources.withColumn("target", F.least(cap.cast("double"), F.lit(level) * F.col("weight")))


def mix_sources(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED
) -> DataFrame:
    """All columns of `docs` (doc_id, text, source and others) and size, source_size, target and taken.

    Sources in order of code point, null last, get the weights in turn and share `share` times all words; see
    water_fill. A source's target is met by whole repetitions of all its documents, and one fractional one: its
    documents in a seeded order until the words are reached, the last one in part. So taken words of a source
    differ from its target by rounding only, no document exceeds `epochs` times its size, and reruns agree. A null
    or empty text has size 0 and takes nothing; rows of equal id follow each other and are counted one by one.
    Columns of `docs` with the added names are replaced.
    """
    kept = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    sized = docs.select(*kept).withColumns(
        {
            "__size": word_count("text"),
            "__key": _source_key("source"),
            "__order": F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).cast("binary")),
        }
    )
    totals = materialize(sized.groupBy("__key").agg(F.sum("__size").alias("size")), "mix-sizes")
    ranked = row_numbers(totals.withColumn("__all", F.lit(0)), ["__all"], ["__key"], F.substring("__key", 1, 4), "rank")
    turn = F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int")
    weighted = materialize(ranked.select("__key", "size", F.get(F.array(*[F.lit(w) for w in weights]), turn).alias("weight")), "mix-sources")
    filled = water_fill(weighted, share, epochs)
    plan = filled.select(
        "__key", F.col("size").alias("source_size"), "target",
        F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0).alias("__whole"),
    ).withColumn("__part", F.floor(F.col("target") - F.col("__whole") * F.col("source_size") + 0.5).cast("long"))
    # Slices of the seeded order spread a large source over many tasks.
    summed = running(sized, ["__key"], ["__order", "__size"], F.substring("__order", 1, 2), F.col("__size"), "__upto")
    before = F.col("__upto") - F.col("__size")
    extra = F.least(F.col("__size"), F.greatest(F.lit(0).cast("long"), F.col("__part") - before))
    taken = (F.col("__whole") * F.col("__size") + extra).cast("long")
    joined = summed.join(plan, "__key")
    return joined.select(*kept, F.col("__size").alias("size"), "source_size", "target", taken.alias("taken"))


def mixed_rows(mixed: DataFrame) -> DataFrame:
    """The sampled corpus: of each row of `mixed` (text, size, taken and others; see mix_sources) as many rows as it is taken.

    `copy` numbers them from 1. Whole repetitions have the text as it is; a remainder of k words is a last row with the
    text up to the end of its k-th word. A row with taken 0 gives none. size and taken are those of the row given out,
    so both sum up to the taken words; other columns stay as they are, also a length of the whole text.
    """
    columns = [c for c in mixed.columns if c != "copy"]
    part = F.col("taken") % F.col("size")
    copies = F.ceil(F.col("taken") / F.col("size")).cast("int")
    rows = mixed.select(*columns).filter("size > 0 AND taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    cut = (part > 0) & (F.col("copy") == copies)
    # Words and what stands before each of them, joined again, are the text up to a word's end.
    gaps, words = F.split("text", WORD, -1), F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    begin = F.array_join(F.slice(F.zip_with(gaps, words, lambda g, w: F.concat(g, w)), F.lit(1), part.cast("int")), "")
    n = F.when(cut, part).otherwise(F.col("size"))
    return rows.withColumns({"text": F.when(cut, begin).otherwise(F.col("text")), "size": n, "taken": n})


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    """How many words of each document a mix of all sources at their weights takes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
    md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '-')) AS ord
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM sized GROUP BY source),
steps AS (
  SELECT *, row_number() OVER o AS k, 1.5 * sum(source_size) OVER () AS budget,
    coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM sources WINDOW o AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST)),
level AS (
  SELECT CAST(budget - capped AS DOUBLE) / CAST(open_weight AS DOUBLE) AS level FROM steps
  WHERE 2 * source_size >= CAST(budget - capped AS DOUBLE) / CAST(open_weight AS DOUBLE) * weight ORDER BY k LIMIT 1),
plan AS (
  SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE), level * weight) AS target FROM sources, level),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM plan),
summed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY ord, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(whole * size + least(size, greatest(0, floor(target - whole * source_size + 0.5) - before)) AS BIGINT) AS taken
FROM summed JOIN parts ON summed.source IS NOT DISTINCT FROM parts.source
"""
