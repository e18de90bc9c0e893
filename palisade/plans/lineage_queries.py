"""Lineage queries over logged outputs, statements and relation edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.operators import lineage as ln
from palisade.plans.mask_queries import DEPENDENCIES, LINEAGE, RULES
from palisade.plans.registry import over_signals, query, with_ctes
from palisade.sources import tables as t

# Projection items per logged query, four in most; some are stars, some layouts are broken, some items are lost.
_ITEMS = """SELECT query_id, CASE WHEN query_id % 11 = 0 AND slot = 3 THEN 0 ELSE slot END AS select_index, slot,
 (slot = 1 AND query_id % 5 IN (2, 3, 4)) OR (slot = 2 AND query_id % 5 = 4) AS variadic, 0 AS arm_index,
 CASE WHEN (slot = 1 AND query_id % 5 IN (2, 3, 4)) OR (slot = 2 AND query_id % 5 = 4) THEN 'wildcard' ELSE 'direct' END AS kind, '' AS operation, 'resolved' AS status,
 p % 2 = 0 AS two_relations, CASE WHEN NOT ((slot = 1 AND query_id % 5 IN (2, 3, 4)) OR (slot = 2 AND query_id % 5 = 4)) THEN concat('c', CAST(slot AS STRING)) END AS dep_column
 FROM (SELECT CAST(floor(o_orderkey / 4) AS BIGINT) AS query_id, CAST(o_orderkey % 4 AS INT) AS slot, CAST(floor(o_totalprice) AS BIGINT) AS p, o_orderkey FROM orders) AS each_item WHERE o_orderkey % 37 <> 3"""
_WIDTH = "CASE query_id % 5 WHEN 0 THEN 5 WHEN 1 THEN 4 WHEN 2 THEN 6 WHEN 3 THEN 3 ELSE 5 END"


@query("align_lineage", with_ctes(f"""
SELECT query_id, position, CASE WHEN lost OR (star AND two) THEN 'opaque' ELSE 'direct' END AS kind,
 CASE WHEN lost THEN coalesce(problem, 'multiple_wildcard_alignment') WHEN star AND two THEN 'wildcard_relation_ambiguous' WHEN star THEN 'wildcard_column' ELSE '' END AS operation,
 CASE WHEN lost OR (star AND two) THEN NULL WHEN star THEN 'r' || position ELSE dep END AS dep_column
FROM (SELECT p.*, idx IS NULL AS lost, i.two_relations AS two, i.dep_column AS dep
 FROM (SELECT *, problem IS NULL AND stars >= 1 AND position >= fs AND width - position > n - ls - 1 AS star, CASE WHEN problem IS NOT NULL THEN NULL
    WHEN stars = 0 OR position < fs THEN position WHEN width - position <= n - ls - 1 THEN n - (width - position) WHEN stars = 1 THEN fs END AS idx
   FROM (SELECT *, unnest(range(width)) AS position, CASE WHEN distinct_indexes < n OR lo <> 0 OR hi <> n - 1 THEN 'invalid_projection_layout' WHEN width < n - stars THEN 'negative_variadic_span'
      WHEN stars = 0 AND n <> width THEN 'fixed_projection_count_mismatch' WHEN stars > 1 AND fs + n - ls - 1 > width THEN 'overlapping_projection_edges' END AS problem FROM layout)) p
 LEFT JOIN items i ON i.query_id = p.query_id AND i.select_index = idx)""", f"items AS ({_ITEMS})", f"""layout AS (
 SELECT query_id, {_WIDTH} AS width, count(*) AS n, count(DISTINCT select_index) AS distinct_indexes, min(select_index) AS lo, max(select_index) AS hi, count(*) FILTER (WHERE items.variadic) AS stars,
  min(select_index) FILTER (WHERE items.variadic) AS fs, max(select_index) FILTER (WHERE items.variadic) AS ls FROM items GROUP BY 1)"""))
def align_lineage(spark, d):
    """All statements, those with fewer items too."""
    items = t.select_over(spark, _ITEMS, "orders", t.load(spark, d, "orders"))
    relation = lambda name: F.struct(F.lit("").alias("schema_name"), F.lit(name).alias("table_name"))
    listed = items.withColumns(
        {
            "relations": F.when(F.col("two_relations"), F.array(relation("a"), relation("b"))).otherwise(F.array(relation("a"))),
            "dep_schema": F.lit(None).cast("string"),
            "dep_table": F.when(F.col("dep_column").isNotNull(), "a"),
            "dep_role": F.when(F.col("dep_column").isNotNull(), "value"),
        }
    ).withColumnRenamed("slot", "item").drop("two_relations")
    width = F.expr(_WIDTH)
    results = items.select("query_id").distinct().select("query_id", F.explode(F.sequence(F.lit(0), width - 1)).alias("position")).withColumn(
        "column_name", F.concat(F.lit("r"), F.col("position").cast("string"))
    )
    aligned = ln.align_lineage(listed, results)
    return aligned.select("query_id", F.col("position").cast("bigint").alias("position"), "kind", "operation", "dep_column")


@query("merge_dependencies", with_ctes("""
SELECT DISTINCT query_id, output_index, dep_schema, dep_table, dep_column, dep_role FROM lineage WHERE dep_column IS NOT NULL""", DEPENDENCIES, LINEAGE))
def merge_dependencies(spark, d):
    return ln.merge_dependencies(t.lineage(spark, d))


@query("exposure_report", with_ctes("""
SELECT dep_table, dep_column, rule_id, kind, dep_role, count(*) AS uses, count(DISTINCT query_id) AS queries FROM (
 SELECT l.*, r.rule_id, row_number() OVER (PARTITION BY l.query_id, l.output_index, l.arm_index, l.dep_index
  ORDER BY CASE WHEN r.table_name = '' THEN 3 WHEN r.schema_name = '' THEN 2 ELSE 1 END, r.rule_id) AS rk
 FROM lineage l JOIN rules r ON r.column_name = l.dep_column AND (r.table_name = '' OR (r.table_name = l.dep_table AND (r.schema_name = '' OR r.schema_name = l.dep_schema))))
WHERE rk = 1 GROUP BY ALL""", DEPENDENCIES, LINEAGE, RULES))
def exposure_report(spark, d):
    return ln.exposure_report(t.lineage(spark, d), t.mask_rules(spark))


@query("table_co_access", over_signals("""
SELECT least(table_1, table_2) AS table_a, greatest(table_1, table_2) AS table_b, count(*) AS queries FROM signals WHERE table_2 IS NOT NULL AND table_1 <> table_2 GROUP BY 1, 2"""))
def table_co_access(spark, d):
    return ln.co_access(t.query_signals(spark, d))


_EDGES = """SELECT concat('t', CAST(o_custkey % 40 AS STRING)) AS source_table, CASE o_orderkey % 3 WHEN 0 THEN 'user2status' WHEN 1 THEN 'homecode' ELSE 'nowhere' END AS source_column,
 concat('t', CAST(o_orderkey % 40 AS STRING)) AS target_table, CASE o_custkey % 2 WHEN 0 THEN 'cust_code' ELSE 'remark' END AS target_column FROM orders"""
_NAMES = f"names AS ({t.COLUMNS_SQL})"
_JUDGED = """judged AS (SELECT e.*, CASE WHEN NOT EXISTS (SELECT 1 FROM names c WHERE c.table_name = source_table AND c.column_name = source_column)
  OR NOT EXISTS (SELECT 1 FROM names c WHERE c.table_name = target_table AND c.column_name = target_column) THEN 'not_visible'
  WHEN source_table = target_table THEN 'self_relation' WHEN n > 1 THEN 'repeated' END AS reason FROM (SELECT *, count(*) AS n FROM edges GROUP BY ALL) e)"""


def _edges(spark, d):
    return ln.relation_edges(t.select_over(spark, _EDGES, "orders", t.load(spark, d, "orders")), t.column_names(spark, d))


@query("relation_edges", with_ctes("""
SELECT source_table, source_column, target_table, target_column FROM judged WHERE reason IS NULL""", f"edges AS ({_EDGES})", _NAMES, _JUDGED))
def relation_edges(spark, d):
    return _edges(spark, d)[0]


@query("refused_edges", with_ctes("""
SELECT source_table, source_column, target_table, target_column, reason FROM judged WHERE reason IS NOT NULL""", f"edges AS ({_EDGES})", _NAMES, _JUDGED))
def refused_edges(spark, d):
    return _edges(spark, d)[1]
