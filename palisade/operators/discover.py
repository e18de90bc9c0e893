"""Finding sensitive columns: by name, by evidence over all rows, and what rule to advise."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.profile import per_column
from palisade.functions.text import as_column, utrim
from palisade.functions.validators import validator
from palisade.session import spread

# Categories in order of preference, and the name phrases of each.
CATEGORIES = ("phone", "email", "idcard", "bankcard", "ip", "birthdate", "date", "number", "generic")
STRONG_PHRASES = {
    "phone": ("phone number", "mobile", "phone"),
    "email": ("email address", "email"),
    "idcard": ("identity number", "id card", "idcard"),
    "bankcard": ("bank card", "bank account"),
    "ip": ("ip address", "client ip", "ip"),
    "birthdate": ("date of birth", "birth date", "dob", "birthday", "birthdate"),
    "date": (
        "created at", "updated at", "create time", "update time", "order date", "ordered at", "event time",
        "date time", "timestamp", "date"),
    "number": (
        "unit price", "total amount", "amount", "salary", "balance", "price", "quantity", "qty", "stock",
        "income", "score"),
    "generic": ("full name", "first name", "last name", "user name", "username", "address"),
}
MEDIUM_PHRASES = {
    "phone": ("tel",),
    "email": ("mail",),
    "idcard": ("identity",),
    "bankcard": ("card no",),
    "birthdate": ("birth",),
    "generic": ("name", "addr", "notes", "note", "remark", "description", "comment"),
}
MANUAL_REVIEW = "generic name match needs a manual review"


def _tier(category: str) -> int:
    return {"date": 1, "number": 1, "generic": 2}.get(category, 0)


def _ranked_phrases() -> list[tuple[str, str, str]]:
    """(phrase, category, strength), best first: tier, longer phrase, preference, strength, spelling."""
    every = [(p, c, "strong") for c, ps in STRONG_PHRASES.items() for p in ps]
    every += [(p, c, "medium") for c, ps in MEDIUM_PHRASES.items() for p in ps]
    return sorted(
        every,
        key=lambda e: (_tier(e[1]), -len(e[0].split()), CATEGORIES.index(e[1]), e[2] != "strong", e[0].split()),
    )


def name_tokens(c: Column | str) -> Column:
    """Lower-case words of an identifier: split at symbols, aB, a1, 1a and ABc edges."""
    words = F.regexp_replace(utrim(as_column(c)), r"[^\p{L}\p{Nd}]+", " ")
    edges = r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Nd})(?=\p{L})|(?<=\p{L})(?=\p{Nd})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"
    return F.filter(F.split(F.lower(F.regexp_replace(words, edges, " ")), " "), lambda t: t != "")


def classify_columns(catalog: DataFrame, categories: Sequence[str] | None = None) -> DataFrame:
    """Adds category, strength and signal to the columns whose name matches a phrase.

    The phrases are held in order of precedence, so the first contained one wins. A name is split once and its winner
    looked for once: both stand behind one generator, which no later projection or filter repeats. The allow-list is
    applied to the winner, not to the candidates.
    """
    padded = F.concat(F.lit(" "), F.array_join(name_tokens("column_name"), " "), F.lit(" "))
    phrases = F.array(
        *[F.struct(F.lit(f" {p} ").alias("phrase"), F.lit(c).alias("category"), F.lit(s).alias("strength")) for p, c, s in _ranked_phrases()]
    )
    winners = F.flatten(F.transform(F.array(padded), lambda text: F.slice(F.filter(phrases, lambda p: text.contains(p["phrase"])), 1, 1)))
    held = [c for c in catalog.columns if c.lower() not in ("category", "strength")]
    found = spread(catalog).select(*held, F.explode(winners).alias("__winner"))
    found = found.select(*held, F.col("__winner.category").alias("category"), F.col("__winner.strength").alias("strength"))
    if categories is not None:
        found = found.filter(F.col("category").isin(*categories))
    return found.withColumn("signal", F.concat_ws("_", F.lit("column_name"), "strength", "category"))


def profile_evidence(df: DataFrame, candidates: Mapping[str, str], ref_date: dt.date) -> DataFrame:
    """Eligible (non-blank) and matching cells of each candidate column, over all rows in one aggregate."""
    def aggregates(i: int, name: str) -> list[Column]:
        cell = F.col(name).cast("string")
        check = validator(candidates[name], cell, ref_date)
        if check is None:
            return [F.lit(0).cast("bigint").alias(f"__e{i}"), F.lit(0).cast("bigint").alias(f"__m{i}")]
        filled = F.coalesce(utrim(cell) != "", F.lit(False))
        return [F.count_if(filled).alias(f"__e{i}"), F.count_if(filled & check).alias(f"__m{i}")]

    def row(i: int, name: str) -> Column:
        return F.struct(
            F.lit(name).alias("column_name"), F.lit(candidates[name]).alias("category"),
            F.col(f"__e{i}").alias("eligible"), F.col(f"__m{i}").alias("matched"),
        )

    return per_column(df, list(candidates), aggregates, row)


def score_findings(evidence: DataFrame, sampled: bool = True) -> DataFrame:
    """Confidence from name strength and evidence; contradicted or unsupported candidates are dropped."""
    eligible, matched = F.col("eligible"), F.col("matched")
    supports = (eligible >= 3) & (matched * 100 >= eligible * 80)
    contradicts = (eligible >= 3) & (matched * 100 < eligible * 50)
    strong = F.col("strength") == "strong"
    unsampled = F.when(strong, "medium").otherwise("low")
    if not sampled:
        return evidence.withColumn("confidence", unsampled)
    capped = F.when(F.col("category").isin("number", "date"), "medium").otherwise("high")
    confidence = (
        F.when(F.col("category") == "generic", unsampled)
        .when(strong & supports, capped)
        .when(strong & contradicts, F.lit(None).cast("string"))
        .when(strong | supports, "medium")
    )
    return evidence.withColumn("confidence", confidence).filter(F.col("confidence").isNotNull())


def advise(findings: DataFrame, width_hint: str | None = None) -> DataFrame:
    """The rule to propose for each finding. `width_hint` names a column of bucket widths for numbers."""
    hint = F.col(width_hint) if width_hint else F.lit(None).cast("bigint")
    category = F.col("category")
    review = (category == "generic") & (F.col("strength") != "strong")
    algorithm = (
        F.when(review, F.lit(None).cast("string"))
        .when(category == "number", F.when(hint >= 1, "range").otherwise("block"))
        .when(category == "date", "range")
        .when(category == "generic", "block")
        .otherwise("mask")
    )
    return findings.withColumns(
        {
            "algorithm": algorithm,
            "bucket_width": F.when((category == "number") & (hint >= 1), hint),
            "granularity": F.when(category == "date", "month"),
            "manual_review": review,
            "review_reason": F.when(review, MANUAL_REVIEW),
        }
    )


def scan_tables(
    tables: Mapping[str, DataFrame],
    ref_date: dt.date,
    sampling: bool = True,
    categories: Sequence[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Findings and counters of a scan over whole tables.

    Names come from the schemas; each table then contributes one aggregate job to the union,
    and the jobs run together when the result is read.
    """
    spark = next(iter(tables.values())).sparkSession
    catalog = spark.createDataFrame(
        [(n, i, f.name, o) for i, (n, df) in enumerate(tables.items()) for o, f in enumerate(df.schema.fields, start=1)],
        "table_name string, table_order int, column_name string, ordinal int",
    )
    named = classify_columns(catalog, categories)
    candidates = named.collect()  # one row per matching column of the schemas, not data
    parts = []
    for name, df in tables.items():
        wanted = {r["column_name"]: r["category"] for r in candidates if r["table_name"] == name}
        if wanted and sampling:
            parts.append(profile_evidence(df, wanted, ref_date).withColumn("table_name", F.lit(name)))
    if parts:
        measured = reduce(DataFrame.unionByName, parts).drop("category")
        evidence = named.join(measured, ["table_name", "column_name"], "left")
    else:
        evidence = named.withColumns({"eligible": F.lit(0).cast("bigint"), "matched": F.lit(0).cast("bigint")})
    findings = advise(score_findings(evidence, sampling)).orderBy("table_order", "ordinal", "column_name")
    stats = spark.createDataFrame(
        [(len(tables), sum(len(df.columns) for df in tables.values()), len(candidates))],
        "tables_scanned int, columns_seen int, candidate_columns int",
    )
    return findings, stats


def plan_rule_merge(drafts: DataFrame, rules: DataFrame) -> DataFrame:
    """What applying discovered rules would do: create, existing, covered_by_global or conflict.

    Both sides hold datasource_id, schema_name, table_name, column_name, sensitive_type, algorithm
    and bucket_width, granularity; `drafts` add draft_id, `rules` rule_id and enabled. One conflict
    withholds every creation.
    """
    scope = ["datasource_id", "schema_name", "table_name", "__column"]
    shape = F.concat_ws(
        "|", F.lower(F.trim("sensitive_type")), F.lower(F.trim("algorithm")),
        F.coalesce(F.col("bucket_width").cast("string"), F.lit("")), F.coalesce(F.lower(F.trim("granularity")), F.lit("")),
    )
    wanted = drafts.withColumns({"__column": F.lower(F.trim("column_name")), "__shape": shape})
    held = rules.withColumns(
        {
            "__column": F.lower(F.trim("column_name")), "__shape": shape,
            "datasource_id": F.coalesce(F.trim("datasource_id"), F.lit("")),
        }
    )
    scoped = held.groupBy(*scope).agg(F.min_by(F.struct("rule_id", "__shape"), "rule_id").alias("scoped"))
    covering = held.filter((F.col("schema_name") == "") & (F.col("table_name") == "") & F.col("enabled"))
    everywhere = covering.filter(F.col("datasource_id") == "").groupBy("__column").agg(F.max("rule_id").alias("any_source"))
    per_source = covering.filter(F.col("datasource_id") != "").groupBy("datasource_id", "__column").agg(
        F.max("rule_id").alias("one_source")
    )
    # The first draft of a scope is the one that would be created; later ones meet it as a rule.
    first = wanted.groupBy(*scope).agg(F.min_by(F.struct("draft_id", "__shape"), "draft_id").alias("first"))
    joined = (
        wanted.join(scoped, scope, "left")
        .join(everywhere, "__column", "left")
        .join(per_source, ["datasource_id", "__column"], "left")
        .join(first, scope)
    )
    covered = F.greatest("any_source", "one_source")
    repeated = F.col("first.draft_id") != F.col("draft_id")
    outcome = (
        F.when(F.col("scoped").isNotNull(), F.when(F.col("scoped.__shape") == F.col("__shape"), "existing").otherwise("conflict"))
        .when(covered.isNotNull(), "covered_by_global")
        .when(repeated, F.when(F.col("first.__shape") == F.col("__shape"), "existing").otherwise("conflict"))
        .otherwise("create")
    )
    planned = joined.select(
        "draft_id",
        outcome.alias("outcome"),
        F.when(F.col("scoped").isNotNull(), F.col("scoped.rule_id")).otherwise(covered).alias("rule_id"),
    )
    blocked = planned.agg(F.coalesce(F.max(F.col("outcome") == "conflict"), F.lit(False))).scalar()
    withheld = F.when((F.col("outcome") == "create") & blocked, "withheld").otherwise(F.col("outcome"))
    return planned.select("draft_id", withheld.alias("outcome"), "rule_id")
