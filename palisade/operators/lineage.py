"""Lineage of logged queries: alignment to result positions, exposure, and relation edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.operators.redact import keyed_rules, normalize_name


def align_lineage(items: DataFrame, results: DataFrame) -> DataFrame:
    """Arms of each result position; one star fills the span it stands for.

    `items`: query_id, item, select_index, variadic, arm_index, kind, operation, status, relations (array
    of schema_name/table_name), dep_schema, dep_table, dep_column, dep_role, one row per dependency.
    `results`: query_id, position, column_name. Where the layout does not fit, every position of
    the query is opaque.
    """
    arms = items.select("query_id", "item", "select_index", "variadic", "arm_index").distinct()
    per_item = arms.groupBy("query_id", "item", "select_index").agg(F.max("variadic").alias("variadic"), F.count("arm_index").alias("arms"))
    per_index = per_item.groupBy("query_id", "select_index").agg(
        F.count(F.lit(1)).alias("same"), F.max("variadic").alias("variadic"), F.min("arms").alias("fewest"), F.max("arms").alias("most")
    )
    starred = F.when(F.col("variadic"), F.col("select_index"))
    layout = per_index.groupBy("query_id").agg(
        F.sum("same").alias("items"),
        F.max("same").alias("same"),
        F.min("select_index").alias("first_index"),
        F.max("select_index").alias("last_index"),
        F.count_if("variadic").alias("stars"),
        F.min(starred).alias("first_star"),
        F.max(starred).alias("last_star"),
        F.min("fewest").alias("fewest"),
        F.max("most").alias("most"),
    )
    widths = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("width"))
    n, width = F.col("items"), F.col("width")
    sound = (F.col("same") == 1) & (F.col("first_index") == 0) & (F.col("last_index") == n - 1) & (F.col("fewest") == F.col("most")) & (F.col("fewest") > 0)
    prefix, suffix = F.col("first_star"), n - F.col("last_star") - 1
    problem = (
        F.when(n.isNull(), "missing_projection_lineage")
        .when(~sound, "invalid_projection_layout")
        .when(width < n - F.col("stars"), "negative_variadic_span")
        .when((F.col("stars") == 0) & (n != width), "fixed_projection_count_mismatch")
        .when((F.col("stars") > 1) & (prefix + suffix > width), "overlapping_projection_edges")
    )
    placed = results.join(widths, "query_id").join(layout, "query_id", "left").withColumn("problem", problem)
    from_end = width - F.col("position")
    index = (
        F.when((F.col("stars") == 0) | (F.col("position") < prefix), F.col("position"))
        .when(from_end <= suffix, n - from_end)
        .when(F.col("stars") == 1, F.col("first_star"))
    )
    in_star = (F.col("stars") >= 1) & (F.col("position") >= prefix) & (from_end > suffix)
    placed = placed.withColumns(
        {"select_index": F.when(F.col("problem").isNull(), index), "in_star": F.coalesce(in_star & F.col("problem").isNull(), F.lit(False))}
    ).select("query_id", "position", "column_name", "problem", "select_index", "in_star")

    joined = placed.join(items.drop("variadic", "item"), ["query_id", "select_index"], "left")
    one_relation = F.size("relations") == 1
    opens = F.col("in_star") & (F.col("arm_index") == 0) & (F.col("kind") == "wildcard") & (F.col("status") == "resolved")
    named = opens & one_relation & (F.col("column_name") != "")
    lost = F.col("select_index").isNull()
    relation = F.get("relations", F.lit(0))
    operation = (
        F.when(lost, F.coalesce("problem", F.lit("multiple_wildcard_alignment")))
        .when(named, "wildcard_column")
        .when(opens, "wildcard_relation_ambiguous")
        .when(F.col("in_star"), "wildcard_branch_unknown")
        .otherwise(F.col("operation"))
    )
    keep = ~F.col("in_star") & ~lost
    return joined.select(
        "query_id",
        "position",
        F.coalesce("arm_index", F.lit(0)).alias("arm_index"),
        F.when(named, "direct").when(keep, F.col("kind")).otherwise("opaque").alias("kind"),
        operation.alias("operation"),
        F.when(named, "resolved").when(keep, F.col("status")).otherwise("opaque").alias("status"),
        F.when(named, relation["schema_name"]).otherwise(F.col("dep_schema")).alias("dep_schema"),
        F.when(named, relation["table_name"]).otherwise(F.col("dep_table")).alias("dep_table"),
        F.when(named, F.col("column_name")).otherwise(F.col("dep_column")).alias("dep_column"),
        F.when(named, "value").otherwise(F.col("dep_role")).alias("dep_role"),
    )


def merge_dependencies(lineage: DataFrame) -> DataFrame:
    """Dependencies of each output without repeats, in long form (one row each)."""
    return (
        lineage.filter(F.col("dep_column").isNotNull())
        .select("query_id", "output_index", "dep_schema", "dep_table", "dep_column", "dep_role")
        .distinct()
    )


def exposure_report(lineage: DataFrame, rules: DataFrame) -> DataFrame:
    """How often protected columns reach outputs: by table, column, rule, expression kind and role."""
    column = normalize_name("dep_column")
    sep = "\u0001"
    keys = F.array_compact(
        F.array(
            F.when(
                F.coalesce("dep_schema", F.lit("")) != "",
                F.struct(F.lit(1).alias("tier"), F.concat_ws(sep, F.lit("e"), "dep_schema", "dep_table", column).alias("rule_key")),
            ),
            F.struct(F.lit(2).alias("tier"), F.concat_ws(sep, F.lit("t"), "dep_table", column).alias("rule_key")),
            F.struct(F.lit(3).alias("tier"), F.concat_ws(sep, F.lit("g"), column).alias("rule_key")),
        )
    )
    # One rule per column origin is settled on the distinct origins, before the log is touched.
    origins = lineage.filter(F.col("dep_column").isNotNull()).select("dep_schema", "dep_table", "dep_column").distinct()
    ruled = (
        origins.select("*", F.inline(keys))
        .join(keyed_rules(rules), "rule_key")
        .groupBy("dep_schema", "dep_table", "dep_column")
        .agg(F.min_by("rule_id", F.struct("tier", "rule_id")).alias("rule_id"))
    )
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("dep_schema", "dep_table", "dep_column")]
    hits = lineage.alias("l").join(ruled.alias("r"), on)
    outputs = hits.groupBy("l.dep_table", "l.dep_column", "rule_id", "kind", "dep_role", "query_id").agg(
        F.count(F.lit(1)).alias("uses")
    )
    return outputs.groupBy("dep_table", "dep_column", "rule_id", "kind", "dep_role").agg(
        F.sum("uses").alias("uses"), F.count(F.lit(1)).alias("queries")
    )


def co_access(uses: DataFrame) -> DataFrame:
    """Tables used by one query together, as counted ordered pairs.

    Pairs are formed inside one statement's own short table list, never across queries.
    """
    tables = F.array_sort(F.array_distinct("tables"))
    pairs = F.flatten(
        F.transform(
            tables,
            lambda a: F.transform(
                F.filter(tables, lambda b: a < b), lambda b: F.struct(a.alias("table_a"), b.alias("table_b"))
            ),
        )
    )
    return uses.select(F.inline(pairs)).groupBy("table_a", "table_b").agg(F.count(F.lit(1)).alias("queries"))


def relation_edges(edges: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable relation edges and the refused ones.

    An edge needs both ends in the visible catalog, two different tables, and to be listed once.
    """
    ends = ["source_table", "source_column", "target_table", "target_column"]
    known = catalog.select("table_name", "column_name").distinct()
    source = known.select(F.col("table_name").alias("source_table"), F.col("column_name").alias("source_column"), F.lit(True).alias("has_source"))
    target = known.select(F.col("table_name").alias("target_table"), F.col("column_name").alias("target_column"), F.lit(True).alias("has_target"))
    counted = edges.groupBy(*ends).agg(F.count(F.lit(1)).alias("n"))
    judged = counted.join(source, ["source_table", "source_column"], "left").join(target, ["target_table", "target_column"], "left")
    reason = (
        F.when(F.col("has_source").isNull() | F.col("has_target").isNull(), "not_visible")
        .when(F.col("source_table") == F.col("target_table"), "self_relation")
        .when(F.col("n") > 1, "repeated")
    )
    judged = judged.withColumn("reason", reason)
    return (
        judged.filter(F.col("reason").isNull()).select(*ends),
        judged.filter(F.col("reason").isNotNull()).select(*ends, "reason"),
    )
