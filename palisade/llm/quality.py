"""Quality rules: repetition inside a document, and lines that too many documents of a host share; native functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.runtime import pack_columns, unpack_columns

APART = r"[\x20\x09-\x0D]"
LEAST_WORDS = 10
MOST_REPEATED = 20  # percent of words
WINDOW = 5
# A line is boilerplate of a host if more distinct documents than both limits have it.
LINE_DOCS = 10
LINE_SHARE = 0.05
LEAST_LEFT = 0.5


def _words(text: str) -> Column:
    return F.filter(F.split(F.col(text), APART + "+", -1), lambda w: w != "")


def _with_repeated(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words in windows that occur twice or more. Works on `__windows`, hashes of five words each.

    Each step is a column of its own: an array that a lambda looks into must not be worked out anew for each element.
    """
    windows = F.col("__windows")
    none = F.size(F.array_distinct(windows)) == F.size(windows)
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("__pairs", F.when(~none, pairs))
    again = lambda x, k: (F.get("__pairs", k - 1).h == x.h) | (F.get("__pairs", k + 1).h == x.h)
    twice = F.filter(F.transform("__pairs", lambda x, k: F.when(again(x, k), x.i)), lambda i: i.isNotNull())
    df = df.withColumn("__starts", F.sort_array(twice))
    # Each start covers the words up to the next start, five at most.
    covers = F.transform("__starts", lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get("__starts", k + 1) - s, F.lit(WINDOW))))
    total = F.aggregate(covers, F.lit(0).cast("long"), lambda n, x: n + x)
    return df.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long")))


def with_counts(docs: DataFrame) -> DataFrame:
    """All columns of `docs` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of `text` (0 where it is null)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = [c for c in docs.columns if c not in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    split = docs.select(*kept).withColumn("__text", text).withColumn("__words", _words("__text"))
    hashed = split.withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w)))
    at = lambda i, k: F.get("__hashes", i + k)
    windows = F.when(
        F.size("__hashes") >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size("__hashes") - WINDOW), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("__text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    wide = hashed.withColumn("__windows", windows).withColumn("__lines", lines)
    return _with_repeated(wide).select(
        *kept,
        F.size("__words").cast("long").alias("n_words"),
        (F.length("__text") - F.regexp_count("__text", F.lit(APART))).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
    )


def _line_rows(docs: DataFrame) -> DataFrame:
    """One row for each line with words: host, doc_id, hash of the text, place and hash of the line, words in it."""
    key = lambda x: F.lower(F.regexp_replace(x, rf"^{APART}+|{APART}+$", ""))
    lines = F.filter(
        F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("place"), F.xxhash64(key(x)).alias("line"), F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")).alias("n"))),
        lambda x: x.n > 0,
    )
    rows = docs.filter(F.col("text").isNotNull()).select("doc_id", F.col("source").alias("host"), F.xxhash64("text").alias("body"), F.explode(lines).alias("x"))
    return rows.select("host", "doc_id", "body", F.col("x.place").alias("place"), F.col("x.line").alias("line"), F.col("x.n").alias("n"))


def _host_lines(docs: DataFrame, line_docs: int, line_share: float) -> DataFrame:
    """(host, line) of the lines that more than the limits of a host's distinct texts hold."""
    hosts = docs.filter(F.col("text").isNotNull()).groupBy(F.col("source").alias("host")).agg(F.count_distinct(F.xxhash64("text")).alias("docs"))
    counted = _line_rows(docs).select("host", "line", "body").distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    often = counted.filter(F.col("n") > line_docs)
    same = often["host"].eqNullSafe(hosts["host"])
    return often.join(hosts, same).filter(F.col("n") > line_share * F.col("docs")).select(often["host"], "line")


def _common_lines(docs: DataFrame, line_docs: int, line_share: float) -> DataFrame:
    """The rows of _line_rows that are boilerplate of their host; copies of a whole row add theirs once."""
    rows, common = _line_rows(docs), _host_lines(docs, line_docs, line_share)
    same = F.col("host").eqNullSafe(F.col("common_host")) & (rows["line"] == common["line"])
    hit = rows.join(common.withColumnRenamed("host", "common_host"), same)
    return hit.select("doc_id", "host", "body", "place", "n").distinct()


def remove_boilerplate(docs: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """All columns of `docs` (doc_id, text, source and others), their texts without the boilerplate lines of `judge`, and n_removed_lines.

    One row for each row; the lines that stay are joined by line breaks as before. A null text stays null, and a text that
    is all boilerplate becomes an empty one. A column named n_removed_lines is replaced.
    """
    packed = pack_columns(docs, "doc_id", "text", "source").withColumn("body", F.xxhash64("text"))
    places = _common_lines(docs.select("doc_id", "text", "source"), line_docs, line_share).groupBy("doc_id", "host", "body")
    # The numbers of one document's own lines.
    gone = places.agg(F.collect_set("place").alias("gone")).select(F.col("doc_id").alias("__doc_id"), "host", F.col("body").alias("__body"), "gone")
    same = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & F.col("source").eqNullSafe(F.col("host")) & (F.col("body") == F.col("__body"))
    joined = packed.join(gone, same, "left")
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("gone", i))
    n = F.coalesce(F.when(F.col("gone").isNotNull(), F.size("gone")), F.lit(0)).cast("long")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return unpack_columns(joined.withColumn("n_removed_lines", n), docs.columns, "n_removed_lines", text=text)


def judge(
    docs: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, least_left: float = LEAST_LEFT,
    least_words: int = LEAST_WORDS, most_repeated: int = MOST_REPEATED,
) -> DataFrame:
    """doc_id, the counts of with_counts, n_line_words (words in boilerplate lines), base_failed and kept, one row for each row.

    A line, stripped and lower-cased, is boilerplate if more than `line_docs` and more than `line_share` of the distinct
    texts of its host (column source; null is a host too) hold it: copies of one text count once. A document is
    depleted, and not kept, if less than `least_left` of its words or fewer than `least_words` remain without such lines.
    base_failed: fewer than `least_words` words, or more than `most_repeated` percent of them repeated. A null or
    empty text has no words and fails. Rows are told apart by doc_id and text; other columns are left out.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text", "source")
    counted = with_counts(docs.withColumn("body", F.xxhash64("text"))).drop("text")
    words = _common_lines(docs, line_docs, line_share).groupBy("doc_id", "host", "body").agg(F.sum("n").alias("n_line_words"))
    joined = counted.join(
        words.select(*[F.col(c).alias(f"__{c}") for c in ("doc_id", "host", "body")], "n_line_words"),
        F.col("doc_id").eqNullSafe(F.col("__doc_id")) & F.col("source").eqNullSafe(F.col("__host")) & (F.col("body") == F.col("__body")),
        "left",
    )
    line_words = F.coalesce("n_line_words", F.lit(0)).cast("long")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    left = F.col("n_words") - F.col("n_line_words")
    depleted = (F.col("n_line_words") > 0) & ((left < least_left * F.col("n_words")) | (left < least_words))
    depleted = F.coalesce(depleted, F.lit(False))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return joined.select("doc_id", *counts, line_words.alias("n_line_words"), failed.alias("base_failed"), (~failed & ~depleted).alias("kept"))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts of every document, whether the base rules fail, and whether it is kept."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t, text, source FROM documents),
words AS (
  SELECT row, unnest(w) AS word, unnest(range(len(w))) AS i FROM (SELECT row, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM docs)),
windows AS (
  SELECT row, i, [word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o] AS five,
    lead(word, 4) OVER o IS NOT NULL AS whole FROM words WINDOW o AS (PARTITION BY row ORDER BY i)),
again AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, five) AS n FROM windows WHERE whole) WHERE n > 1),
repeated AS (SELECT row, count(DISTINCT i + k) AS n FROM again, range(5) AS r(k) GROUP BY row),
lines AS (
  SELECT row, doc_id, source, text, line, lower(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g')) AS key,
    len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n
  FROM (SELECT row, doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
hosts AS (SELECT source, count(DISTINCT text) AS docs FROM documents WHERE text IS NOT NULL GROUP BY source),
common AS (
  SELECT l.source, key FROM lines l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source
  GROUP BY l.source, key, docs HAVING count(DISTINCT text) > {LINE_DOCS} AND count(DISTINCT text) > {LINE_SHARE} * docs),
gone AS (
  SELECT row, sum(n) AS n FROM lines l JOIN common c ON l.key = c.key AND l.source IS NOT DISTINCT FROM c.source GROUP BY row),
counted AS (
  SELECT d.row, doc_id, CAST(len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce((SELECT count(*) - count(DISTINCT line) FROM lines l WHERE l.row = d.row), 0) AS n_dup_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_line_words
  FROM docs d LEFT JOIN repeated r ON r.row = d.row LEFT JOIN gone g ON g.row = d.row),
judged AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_line_words, base_failed,
  NOT base_failed AND NOT (n_line_words > 0 AND (n_words - n_line_words < {LEAST_LEFT} * n_words OR n_words - n_line_words < {LEAST_WORDS})) AS kept
FROM judged
"""
