"""From raw documents to a training mix: five stages, each written to the shared folder and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import language, leaks, lines, mixing, near
from palisade.llm.runtime import hide_columns, prepare
from palisade.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language. Learns from all labelled documents given.

    Those without a letter go, and those of whose n-grams no language holds more than chance gives. Where no
    document has a label nothing is learned, and all with a letter stay.
    """
    prepare(spark)
    return language.keep_identified(docs, language.fit(docs), above_chance=True)


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines that a document with a smaller id has; n_chars follows the text."""
    prepare(spark)
    docs, back = hide_columns(docs, "n_lines", "n_dropped", "kept_text")
    done = lines.remove_repeated_lines(docs)
    changed = F.col("n_dropped") > 0
    new = {"text": F.when(changed, F.col("kept_text")).otherwise(F.col("text")), "n_chars": F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))}
    return done.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns]).withColumnsRenamed(back)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates.

    A row without an id is a document of its own behind all that have one. Rows that share an id are one document: they
    go or stay together, and of those that stay and share the text too one row stays.
    """
    prepare(spark)
    docs, back = hide_columns(docs, "__id")
    columns = docs.columns
    named = docs.filter(F.col("doc_id").isNotNull()).withColumn("__id", F.col("doc_id").cast("long"))
    unnamed = docs.filter(F.col("doc_id").isNull())
    if not unnamed.isEmpty():
        # Written once, so that a row has one number in all that follows; counted down from the largest.
        number = F.lit(2**63 - 1) - F.monotonically_increasing_id()
        named = named.unionByName(materialize(unnamed.withColumn("__id", number), "near-unnamed"))
    gone = near.near_duplicates(named.select(F.col("__id").alias("doc_id"), "text")).filter(~F.col("kept")).select(F.col("doc_id").alias("__id")).distinct()
    left = named.join(gone, "__id", "left_anti")
    # Only ids are counted, so a corpus without repeated ids is not shuffled for them.
    shared = materialize(named.groupBy("__id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("__id"), "near-shared")
    if not shared.isEmpty():
        once = left.join(shared, "__id", "left_semi").dropDuplicates(["__id", "text"])
        left = left.join(shared, "__id", "left_anti").unionByName(once)
    return left.select(*columns).withColumnsRenamed(back)


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    prepare(spark)
    return leaks.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with size, source_size, target and taken: the words that the mix takes of each, repeats counted."""
    prepare(spark)
    return mixing.mix_sources(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("lines", remove_lines),
    ("near_duplicates", remove_near_duplicates),
    ("leaks", remove_leaks),
    ("mix", mix),
]

# The language stage is a learned model, which SQL cannot express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
