"""Queries of this package and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from palisade.llm import centroids, check_sql, codebooks, ctw, language, leaks, licenses, lines, mixing, near, pii, quality, substring, suffixes, vector_sql
from palisade.llm.runtime import prepare

Query = Callable[[SparkSession, str], DataFrame]


def _configured(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare(spark), sf_dir)

    return run


QUERIES: dict[str, Query] = {
    fn.__name__: _configured(fn)
    for fn in (
        substring.op1_substring_dedup,
        suffixes.op2_suffix_dedup,
        lines.op3_line_dedup,
        language.op4_language_id,
        near.op5_near_dedup,
        leaks.op6_decontaminate,
        pii.op7_pii,
        ctw.op8_lm_score,
        mixing.op9_mix_sources,
        quality.op10_quality_rules,
        centroids.op11_centroid_clusters,
        licenses.op12_license_scan,
        codebooks.op13_vector_codes,
    )
}
# Language ID, personal data and scoring hold learned models, and license places follow from weights of the corpus, which
# SQL cannot express: tests use brute force.
CHECK_SQL: dict[str, str] = {
    "op1_substring_dedup": check_sql.SUBSTRING.strip(),
    "op2_suffix_dedup": check_sql.SUFFIX.strip(),
    "op3_line_dedup": check_sql.LINES.strip(),
    "op5_near_dedup": check_sql.NEAR.strip(),
    "op6_decontaminate": check_sql.LEAKS.strip(),
    "op9_mix_sources": mixing.SQL.strip(),
    "op10_quality_rules": quality.SQL.strip(),
    "op11_centroid_clusters": vector_sql.CENTROIDS.strip(),
    "op13_vector_codes": vector_sql.CODES.strip(),
}
