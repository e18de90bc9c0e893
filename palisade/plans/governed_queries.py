"""Relational queries over governed views: every supported shape, at source and at output."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.functions import masks as m
from palisade.operators.redact import MaskRule
from palisade.operators.rows import Compare
from palisade.plans.governed import Access, assert_visible, carry_filter, governed, register
from palisade.plans.mask_queries import KEY, fingerprint_sql
from palisade.operators.recursion import recurse
from palisade.plans.registry import over_signals, query, with_ctes
from palisade.sources import tables as t

CUSTOMER = Access(
    columns=("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    row_filters=(Compare("c_nationkey", "<", 15),),
    masks=(MaskRule("c_name", "generic", "hash"), MaskRule("c_acctbal", "number", "range", width=1000)),
)
ORDERS = Access(columns=("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderdate"), row_filters=(Compare("o_totalprice", ">", 1000.0),))
LINES = Access(columns=("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag"))

_BAND = "'[' || (floor(c_acctbal / 1000)::BIGINT * 1000) || ',' || (floor(c_acctbal / 1000)::BIGINT * 1000 + 1000) || ')'"
G_CUSTOMER = f"""g_customer AS (SELECT c_custkey, {fingerprint_sql('c_name')} AS c_name, c_nationkey, {_BAND} AS c_acctbal, c_mktsegment
 FROM customer WHERE c_nationkey < 15)"""
G_ORDERS = "g_orders AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, o_orderdate FROM orders WHERE o_totalprice > 1000)"
G_LINES = "g_lines AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_returnflag FROM lineitem)"
VIEWS = (G_CUSTOMER, G_ORDERS, G_LINES)


def views(spark, d):
    register(spark, {
        "g_customer": governed(t.load(spark, d, "customer"), CUSTOMER, KEY),
        "g_orders": governed(t.load(spark, d, "orders"), ORDERS),
        "g_lines": governed(t.load(spark, d, "lineitem"), LINES),
    })


def _same(name: str, text: str) -> None:
    """Register a query whose text is the same on both engines, over the governed views."""

    @query(name, with_ctes(f"SELECT * FROM ({text}) AS whole", *VIEWS))
    def run(spark, d):
        views(spark, d)
        return spark.sql(text)


@query("governed_view", with_ctes("SELECT * FROM g_customer", *VIEWS))
def governed_view(spark, d):
    return governed(t.load(spark, d, "customer"), CUSTOMER, KEY)


@query("governed_revenue", with_ctes("""
SELECT c_acctbal, c_mktsegment, count(*) AS orders, count(DISTINCT c_name) AS names, round(sum(o_totalprice), 2) AS revenue
FROM g_customer JOIN g_orders ON c_custkey = o_custkey GROUP BY 1, 2""", *VIEWS))
def governed_revenue(spark, d):
    customer = governed(t.load(spark, d, "customer"), CUSTOMER, KEY)
    orders = governed(t.load(spark, d, "orders"), ORDERS)
    return customer.join(orders, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_acctbal", "c_mktsegment").agg(
        F.count(F.lit(1)).alias("orders"), F.countDistinct("c_name").alias("names"), F.round(F.sum("o_totalprice"), 2).alias("revenue")
    )


@query("mask_at_output", f"""
SELECT c_mktsegment, n, '[' || (floor(balance / 100000)::BIGINT * 100000) || ',' || (floor(balance / 100000)::BIGINT * 100000 + 100000) || ')' AS balance
FROM (SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer WHERE c_acctbal > 5000 GROUP BY 1)""")
def mask_at_output(spark, d):
    """Filters and sums see the raw balance; only the shown total is put into a band."""
    totals = t.load(spark, d, "customer").filter(F.col("c_acctbal") > 5000).groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).cast("decimal(20,2)").alias("balance")
    )
    return totals.withColumn("balance", m.mask_bucket("balance", 100000))


_same("projection_arithmetic", """
SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_quantity + 1 AS next_quantity, CAST(l_quantity AS INT) % 7 AS remainder,
 l_discount > 0.05 AND NOT (l_returnflag = 'N') AS kept, l_returnflag IS NULL AS missing, 1 AS one, true AS yes FROM g_lines WHERE l_quantity >= 25 OR l_returnflag <> 'A'""")
_same("inner_join", """
SELECT o_orderpriority, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM g_orders JOIN g_lines ON o_orderkey = l_orderkey AND l_quantity > 10 GROUP BY o_orderpriority""")
_same("left_join", """
SELECT c_custkey, c_name, count(o_orderkey) AS orders FROM g_customer LEFT JOIN g_orders ON c_custkey = o_custkey AND o_totalprice > 300000 GROUP BY c_custkey, c_name""")
_same("exists_subquery", """
SELECT c_custkey, c_mktsegment FROM g_customer c WHERE EXISTS (SELECT 1 FROM g_orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)
 AND NOT EXISTS (SELECT 1 FROM g_orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')""")
# NOT IN over a column that may be null, written so that it is a shuffled anti join with the null rules beside it:
# as one predicate it would send all keys of the subquery to every task.
_same("in_subquery", """
SELECT o_orderkey, o_totalprice FROM g_orders WHERE o_custkey IN (SELECT c_custkey FROM g_customer WHERE c_mktsegment = 'BUILDING')
 AND NOT EXISTS (SELECT 1 FROM g_lines WHERE l_returnflag = 'R' AND l_orderkey = o_orderkey)
 AND (SELECT count(*) FROM g_lines WHERE l_returnflag = 'R' AND l_orderkey IS NULL) = 0
 AND (o_orderkey IS NOT NULL OR (SELECT count(*) FROM g_lines WHERE l_returnflag = 'R') = 0)""")
_same("literal_limit", "SELECT o_orderkey, o_totalprice FROM g_orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
_same("grouped_aggregates", """
SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS big, round(avg(l_discount), 8) AS mean_discount, min(l_quantity) AS low, max(l_quantity) AS high,
 round(percentile_cont(0.5) WITHIN GROUP (ORDER BY l_extendedprice), 4) AS middle FROM g_lines GROUP BY l_returnflag HAVING count(*) > 10""")
_same("window_functions", """
SELECT o_orderkey, o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS nth,
 round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last_three FROM g_orders""")
_same("set_union", """
SELECT c_mktsegment AS v FROM g_customer UNION SELECT o_orderpriority FROM g_orders UNION ALL SELECT l_returnflag FROM g_lines WHERE l_quantity = 50""")
_same("set_intersect_except", """
(SELECT c_custkey AS k FROM g_customer INTERSECT SELECT o_custkey FROM g_orders) EXCEPT SELECT o_custkey FROM g_orders WHERE o_orderpriority = '5-LOW'""")
_same("cte_derived_scalar", """
WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS total FROM g_orders GROUP BY o_custkey)
SELECT c_mktsegment, count(*) AS n FROM g_customer JOIN (SELECT * FROM spend WHERE total > (SELECT avg(total) FROM spend)) s ON s.o_custkey = c_custkey
JOIN (VALUES ('BUILDING'), ('MACHINERY')) v(segment) ON v.segment = c_mktsegment GROUP BY c_mktsegment""")
_same("case_and_null_functions", """
SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band,
 coalesce(nullif(o_orderpriority, '5-LOW'), 'none') AS priority, greatest(o_totalprice, 200000.0) AS at_least, least(o_totalprice, 200000.0) AS at_most,
 CAST(o_orderkey AS STRING) || '-' || o_orderpriority AS label FROM g_orders""")


@query("recursive_cte", """
WITH RECURSIVE chain(start, c, step) AS (SELECT c_custkey, c_custkey, 0 FROM customer UNION ALL SELECT start, CAST(floor(c / 3) AS BIGINT), step + 1 FROM chain WHERE c > 0)
SELECT step, count(*) AS n FROM chain GROUP BY step""")
def recursive_cte(spark, d):
    """Each step works on distinct nodes with their counts, so its rows shrink and no recursion limit applies."""
    nodes = t.load(spark, d, "customer").groupBy(F.col("c_custkey").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    onward = lambda rows: rows.filter("c > 0").groupBy(F.floor(F.col("c") / 3).alias("c")).agg(F.sum("n").alias("n"))
    return recurse(nodes, onward, round_column="step").groupBy("step").agg(F.sum("n").alias("n"))


_same("lateral_top", """
SELECT c.c_custkey, x.best FROM g_customer c, LATERAL (SELECT max(o_totalprice) AS best FROM g_orders o WHERE o.o_custkey = c.c_custkey) x WHERE x.best IS NOT NULL""")


@query("arrays_and_rows", with_ctes("""
SELECT o_orderkey, [o_orderpriority, 'x'][1] AS first_item, len([o_custkey, o_orderkey]) AS items, {'p': o_totalprice, 'q': o_orderkey}.q AS part FROM g_orders""", *VIEWS))
def arrays_and_rows(spark, d):
    views(spark, d)
    return spark.sql("""SELECT o_orderkey, array(o_orderpriority, 'x')[0] AS first_item, CAST(size(array(o_custkey, o_orderkey)) AS BIGINT) AS items,
      named_struct('p', o_totalprice, 'q', o_orderkey).q AS part FROM g_orders""")


@query("object_aggregate", with_ctes("""
SELECT c_custkey, array_to_string(list_sort(list(o_orderpriority || '=' || n)), ',') AS counts FROM (
 SELECT o_custkey AS c_custkey, o_orderpriority, count(*) AS n FROM g_orders GROUP BY 1, 2) GROUP BY 1""", *VIEWS))
def object_aggregate(spark, d):
    """A JSON-like object per key: priorities are few, so each list is short by construction."""
    views(spark, d)
    counts = spark.table("g_orders").groupBy(F.col("o_custkey").alias("c_custkey"), "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    entry = F.concat(F.col("o_orderpriority"), F.lit("="), F.col("n").cast("string"))
    return counts.groupBy("c_custkey").agg(F.array_join(F.array_sort(F.collect_list(entry)), ",").alias("counts"))


@query("mode_aggregate", with_ctes("""
SELECT o_custkey, min(o_orderpriority) AS most_used FROM (SELECT o_custkey, o_orderpriority, rank() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC) AS rk FROM g_orders GROUP BY 1, 2) WHERE rk = 1 GROUP BY 1""", *VIEWS))
def mode_aggregate(spark, d):
    """The most frequent value per key, ties to the smallest: counts first, then one max per key."""
    views(spark, d)
    counts = spark.table("g_orders").groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("o_custkey").agg(F.min_by("o_orderpriority", F.struct(-F.col("n"), "o_orderpriority")).alias("most_used"))


@query("carry_filter", with_ctes("SELECT o_orderpriority, count(*) AS n FROM g_orders WHERE o_custkey < 100 AND o_totalprice > 50000 GROUP BY 1", *VIEWS))
def follow_up(spark, d):
    first_turn = (Compare("o_custkey", "<", 100),)
    orders = carry_filter(first_turn, governed(t.load(spark, d, "orders"), ORDERS))
    return orders.filter(F.col("o_totalprice") > 50000).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("visible_fields", with_ctes("SELECT c_custkey, c_mktsegment FROM g_customer", *VIEWS))
def visible_fields(spark, d):
    return assert_visible(governed(t.load(spark, d, "customer"), CUSTOMER, KEY), ["c_custkey", "c_mktsegment"])


@query("aggregate_or_detail", over_signals("""
SELECT is_pure_aggregate AND NOT has_group_by AS pure_aggregate, count(*) AS n, count(*) FILTER (NOT has_limit AND stmt_type = 'SELECT') AS unlimited FROM signals GROUP BY 1"""))
def aggregate_or_detail(spark, d):
    pure = F.col("is_pure_aggregate") & ~F.col("has_group_by")
    return t.query_signals(spark, d).groupBy(pure.alias("pure_aggregate")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("has_limit") & (F.col("stmt_type") == "SELECT")).alias("unlimited")
    )
