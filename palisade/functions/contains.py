"""Which texts contain which phrases, without comparing every text with every phrase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.session import spread

GRAM = 3


def _grams(text: Column, size: int) -> Column:
    last = F.length(text) - size + 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))


def contains_pairs(hay: DataFrame, hay_id: str, hay_text: str, phrases: DataFrame, phrase: str) -> DataFrame:
    """Distinct (hay_id, phrase) where the text contains the phrase, compared as written.

    Ids must be unique. Texts and phrases meet by the phrase's rarest gram and are then verified, so common grams
    never multiply the pairs. A phrase shorter than a gram is looked up by a gram of its own length.
    """
    hay = spread(hay.select(hay_id, hay_text))
    wanted = phrases.select(F.col(phrase).alias("phrase")).filter(F.length("phrase") > 0).distinct()
    size = F.least(F.length("phrase"), F.lit(GRAM))
    own = F.lit(None).cast("array<string>")
    for n in range(1, GRAM + 1):
        own = F.when(size == n, _grams(F.col("phrase"), n)).otherwise(own)
    offered = wanted.select("phrase", F.explode(own).alias("gram"))
    # Grams of one and two letters are needed only where some phrase is as short; at most three sizes come back.
    sizes = sorted(r["n"] for r in wanted.select(size.alias("n")).distinct().collect())
    if not sizes:
        return hay.select(hay_id, F.lit("").alias("phrase")).limit(0)
    text_grams = F.array_distinct(F.concat(*[_grams(F.col(hay_text), n) for n in sizes]))
    # Of the texts' grams only those that some phrase offers go any further.
    in_text = hay.select(hay_id, F.explode(text_grams).alias("gram")).join(offered.select("gram").distinct(), "gram", "left_semi")
    frequency = in_text.groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
    anchors = (
        offered.join(frequency, "gram", "left")
        .groupBy("phrase")
        .agg(F.min_by("gram", F.struct(F.coalesce("texts", F.lit(0)), "gram")).alias("gram"))
    )
    pairs = in_text.join(anchors, "gram").select(hay_id, "phrase")
    return pairs.join(hay.select(hay_id, hay_text), hay_id).filter(F.col(hay_text).contains(F.col("phrase"))).select(hay_id, "phrase")
