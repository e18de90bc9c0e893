"""Ingest, controlled reads, exports, manifests, reconciliation and retention."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from palisade.operators import reconcile as rc
from palisade.plans.audit_queries import OUTBOX
from palisade.plans.policy_queries import digest_sql, set_digest_sql
from palisade.plans.registry import over_audit, query, with_ctes
from palisade.session import scratch_path
from palisade.sources import export as ex
from palisade.sources import ingest as ig
from palisade.sources import tables as t

# Orders as text cells: blanks, stray control characters, odd numbers and date shapes.
_TEXT = """SELECT CAST(o_orderkey AS STRING) AS key, CASE WHEN o_orderkey % 17 = 0 THEN ' ' ELSE CAST(o_custkey AS STRING) END AS customer,
 CASE WHEN o_orderkey % 19 = 0 THEN '' WHEN o_orderkey % 5 = 0 THEN concat(CAST(o_orderkey AS STRING), '.5') WHEN o_orderkey % 7 = 0 THEN concat('-', CAST(o_orderkey AS STRING), '5e-1') ELSE CAST(o_custkey AS STRING) END AS amount,
 CAST(o_totalprice AS STRING) AS price,
 CASE o_orderkey % 4 WHEN 0 THEN concat(CAST(CAST(o_orderdate AS DATE) AS STRING), 'T06:30:00+02:00') WHEN 1 THEN CAST(CAST(o_orderdate AS DATE) AS STRING)
  WHEN 2 THEN concat(CAST(CAST(o_orderdate AS DATE) AS STRING), ' 08:15') ELSE concat(CAST(CAST(o_orderdate AS DATE) AS STRING), ' 23:59:59') END AS moment,
 CASE WHEN o_orderkey % 41 = 0 THEN concat('a', chr(7), 'b') WHEN o_orderkey % 43 = 0 THEN '=1+1' WHEN o_orderkey % 47 = 0 THEN ' @cmd' WHEN o_orderkey % 53 = 0 THEN 'say "hi", ok' ELSE o_orderpriority END AS note FROM orders"""
TEXT = f"cells AS ({_TEXT})"
NAMES = ["key", "customer", "amount", "price", "moment", "note"]


def _cells(spark, d):
    return t.select_over(spark, _TEXT, "orders", t.load(spark, d, "orders"))


def _csv(spark, d):
    path = scratch_path(spark, "cells")
    _cells(spark, d).write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).option("emptyValue", "").csv(path)
    return path


@query("csv_text_table", with_ctes("SELECT key, coalesce(customer, '') AS customer, coalesce(amount, '') AS amount, price, moment, note FROM cells", TEXT))
def csv_text_table(spark, d):
    table = ig.read_text_table(spark, _csv(spark, d))
    return table.select(*[F.coalesce(c, F.lit("")).alias(c) for c in NAMES])


@query("csv_encoding", with_ctes("""
SELECT count(*) AS lines, count(*) FILTER (CAST(key AS BIGINT) % 7 = 0) AS invalid_utf8, count(*) FILTER (CAST(key AS BIGINT) % 11 = 0) AS with_nul FROM cells""", TEXT))
def csv_encoding(spark, d):
    """Files of several tasks with lines that are no valid UTF-8 or hold a zero byte."""
    path = scratch_path(spark, "cells")
    key = F.col("key").cast("bigint")
    byte = lambda code: F.unhex(F.lit(code)).cast("string")
    mark = F.concat(F.when(key % 7 == 0, byte("E9")).otherwise(""), F.when(key % 11 == 0, byte("00")).otherwise("n"))
    _cells(spark, d).repartition(4).select(F.concat_ws(",", "key", mark)).write.text(path)
    return ig.encoding_report(spark, path)


_SPEC = {"key": "int", "amount": "int", "price": "float", "moment": "datetime", "note": "string"}


@query("infer_types", with_ctes("""
SELECT * FROM (VALUES ('key', 0, 'int'), ('customer', 1, 'int'), ('amount', 2, 'float'), ('price', 3, 'float'), ('moment', 4, 'string'), ('note', 5, 'string')) v(field, position, type)""", TEXT))
def infer_types(spark, d):
    return ig.infer_types(_cells(spark, d))


_AMOUNT = """CASE WHEN trim(amount) = '' THEN NULL WHEN CAST(key AS INT) % 5 = 0 THEN CAST(key AS BIGINT) + 1 WHEN CAST(key AS INT) % 7 = 0 THEN -(CAST(key AS BIGINT) + 1) ELSE CAST(amount AS BIGINT) END"""
_MOMENT = """CASE CAST(key AS INT) % 4 WHEN 0 THEN CAST(substr(moment, 1, 10) AS TIMESTAMP) + INTERVAL 270 MINUTE WHEN 1 THEN CAST(moment AS TIMESTAMP) WHEN 2 THEN CAST(moment || ':00' AS TIMESTAMP) ELSE CAST(moment AS TIMESTAMP) END"""


@query("convert_types", with_ctes(f"""
SELECT CAST(key AS BIGINT) AS key, {_AMOUNT} AS amount, CAST(price AS DOUBLE) AS price, {_MOMENT} AS moment, note, customer FROM cells""", TEXT))
def convert_types(spark, d):
    return ig.convert_types(_cells(spark, d), _SPEC)


@query("quarantined_rows", with_ctes("""
SELECT key, CASE WHEN trim(amount) <> '' AND contains(amount, '.') THEN 'amount' END AS bad_fields FROM cells WHERE contains(amount, '.') AND FALSE
UNION ALL SELECT key, 'note' FROM cells WHERE TRY_CAST(note AS DOUBLE) IS NULL""", TEXT))
def quarantined_rows(spark, d):
    good, bad = ig.convert_types(_cells(spark, d), {"key": "int", "amount": "float", "note": "float"}, on_error="quarantine")
    return bad.select("key", F.array_join("bad_fields", ",").alias("bad_fields"))


@query("ingest_quality", with_ctes("""
SELECT * FROM (VALUES ('row_width', 0::BIGINT), ('cell_too_long', 0), ('invalid_utf8', 0), ('header_blank_or_untrimmed', 0), ('header_control_character', 0), ('header_repeated', 1), ('header_too_long', 0)) v(violation, n)
UNION ALL SELECT 'control_character', count(*) FILTER (contains(note, chr(7))) FROM cells""", TEXT))
def ingest_quality(spark, d):
    return ig.ingest_quality(_cells(spark, d).select("*", F.col("note").alias("Customer")))


@query("typed_preview", with_ctes(f"""
SELECT CAST(key AS BIGINT) AS key, {_AMOUNT} AS amount, {_MOMENT} AS moment FROM cells ORDER BY CAST(key AS BIGINT) LIMIT 10""", TEXT))
def typed_preview(spark, d):
    ordered = _cells(spark, d).orderBy(F.col("key").cast("bigint")).select("key", "amount", "moment")
    return ig.preview(ordered, _SPEC)


@query("sample_columns", "SELECT c_custkey, c_mktsegment FROM customer ORDER BY c_custkey LIMIT 20")
def sample_columns(spark, d):
    return ig.sample_columns(t.load(spark, d, "customer"), ["c_custkey", "c_mktsegment"], 20, order=["c_custkey"])


@query("bounded_read", "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey = 3 AND s_suppkey = (SELECT min(s_suppkey) FROM supplier WHERE s_nationkey = 3)")
def bounded_read(spark, d):
    supplier = t.load(spark, d, "supplier")
    smallest = supplier.filter("s_nationkey = 3").agg(F.min("s_suppkey")).first()[0]
    return ig.bounded_read(supplier, ["s_suppkey", "s_name"], {"s_nationkey": 3, "s_suppkey": -1 if smallest is None else smallest}, 100)


@query("capped_read", "SELECT c_custkey, (SELECT count(*) > 50 FROM customer) AS truncated FROM customer ORDER BY c_custkey LIMIT 50")
def capped_read(spark, d):
    rows, truncated = ig.capped(t.load(spark, d, "customer").orderBy("c_custkey"), 50)
    return rows.select("c_custkey", F.lit(truncated).alias("truncated"))


@query("field_values", "SELECT DISTINCT o_orderpriority FROM orders ORDER BY 1 LIMIT 100")
def field_values(spark, d):
    return ig.field_values(t.load(spark, d, "orders"), "o_orderpriority")


@query("csv_export", with_ctes("""
SELECT key, coalesce(customer, '') AS customer, price, CASE WHEN note = '=1+1' THEN '''=1+1' WHEN note = ' @cmd' THEN ''' @cmd' ELSE note END AS note, '' AS missing FROM cells""", TEXT))
def csv_export(spark, d):
    """Written and read back: what a reader of the files gets."""
    path = scratch_path(spark, "export")
    ex.export_csv(_cells(spark, d), path, ["key", "customer", "price", "note", "missing"])
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in back.columns])


@query("jsonl_export", over_audit("SELECT id, decision, error_code, rule_hits IS NULL AS no_hits FROM audit_log"))
def jsonl_export(spark, d):
    path = scratch_path(spark, "export")
    ex.export_jsonl(t.audit_log(spark, d).select("id", "decision", "error_code", "rule_hits"), path)
    back = spark.read.schema("id bigint, decision string, error_code string, rule_hits string").json(path)
    return back.select("id", "decision", "error_code", F.col("rule_hits").isNull().alias("no_hits"))


@query("export_ceiling", over_audit("SELECT id, decision FROM audit_log WHERE decision = 'deny'"))
def export_ceiling(spark, d):
    """The ceiling is what the table holds in all."""
    log = t.audit_log(spark, d)
    return ex.require_at_most(log.filter("decision = 'deny'").select("id", "decision"), log.count())


_MANIFEST = """
SELECT 'kind=' || k || ' ' || problem AS file, n FROM (VALUES ('missing', 1), ('unlisted', 1), ('size_mismatch', 1), ('digest_mismatch', 1)) v(problem, n),
 (SELECT DISTINCT CAST(p_size % 3 AS VARCHAR) AS k FROM part)"""


def _tampered_folder(spark, d, max_bytes):
    path = scratch_path(spark, "export")
    part = t.load(spark, d, "part").withColumn("kind", F.col("p_size") % 3)
    # Several files in each folder, whose names are equal among the folders.
    part.repartition(4, F.pmod(F.xxhash64("p_partkey"), F.lit(4))).write.partitionBy("kind").csv(path)
    manifest = ex.build_manifest(spark, path).withColumn("folder", F.element_at(F.split("name", "/"), 1))
    turn = F.row_number().over(Window.partitionBy("folder").orderBy("name"))
    listed = manifest.withColumn("n", turn)
    tampered = listed.filter("n <> 1").withColumns(
        {
            "size": F.when(F.col("n") == 2, F.col("size") + 1).otherwise(F.col("size")),
            "sha256": F.when(F.col("n") == 3, F.reverse("sha256")).otherwise(F.col("sha256")),
        }
    )
    ghost = listed.filter("n = 1").withColumn("name", F.concat("folder", F.lit("/ghost.csv")))
    found = ex.verify_manifest(spark, path, tampered.unionByName(ghost).select("name", "size", "sha256"), max_bytes)
    file = F.concat_ws(" ", F.element_at(F.split("name", "/"), 1), "problem")
    return found.groupBy(file.alias("file")).agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("manifest_check", _MANIFEST)
def manifest_check(spark, d):
    """Problems of each folder of a partitioned table whose manifest was tampered with in all four ways."""
    return _tampered_folder(spark, d, ex.MAX_HASHED_BYTES)


@query("manifest_streamed", _MANIFEST)
def manifest_streamed(spark, d):
    """The same, every file hashed as one that is too large for a single value."""
    return _tampered_folder(spark, d, 0)


_CUSTOMER = ["c_acctbal", "c_custkey", "c_mktsegment", "c_name", "c_nationkey"]


@query("frame_digest", f"""
SELECT count(*) AS rows, sha256('c_custkey,c_name,c_nationkey:' || {set_digest_sql()}) AS digest FROM {digest_sql(['c_custkey', 'c_name', 'c_nationkey'], 'customer')}""")
def frame_digest(spark, d):
    return rc.frame_digest(t.load(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"))


def _tree_sql(fan, levels):
    """Levels of digests over digests; a level above a single node leaves it as it is."""
    text = f"l0 AS (SELECT dg AS digest, row_number() OVER (ORDER BY o_orderpriority DESC, o_custkey, dg) - 1 AS pos FROM {digest_sql(_ORDERED, 'orders')}), "
    text += f"l1 AS (SELECT pos // {fan} AS pos, sha256(string_agg(digest, '' ORDER BY pos)) AS digest FROM l0 GROUP BY 1)"
    for k in range(2, levels + 1):
        text += f", l{k} AS (SELECT pos // {fan} AS pos, CASE WHEN (SELECT count(*) FROM l{k - 1}) = 1 THEN max(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest FROM l{k - 1} GROUP BY 1)"
    return text


_ORDERED = ["o_orderkey", "o_custkey", "o_orderpriority"]


@query("ordered_digest", with_ctes(f"""
SELECT (SELECT count(*) FROM orders) AS rows, sha256('{",".join(_ORDERED)}:' || (SELECT count(*) FROM orders)::VARCHAR || ':' || digest) AS digest FROM l4""", _tree_sql(64, 4)))
def ordered_digest(spark, d):
    """A tree of four levels at most over the orders by priority and customer; equal places go by content."""
    orders = t.load(spark, d, "orders").select(*_ORDERED)
    return rc.ordered_digest(orders, [F.desc("o_orderpriority"), "o_custkey"], fan=64)


@query("outbox_projection", over_audit("""
SELECT tenant_id, decision, action, actor_id, event_uuid, NULL::BIGINT AS est_rows FROM (SELECT *, 'allow' AS decision FROM outbox)
UNION ALL SELECT tenant_id, decision, NULL, NULL, event_uuid, est_rows FROM audit_log""", OUTBOX))
def outbox_projection(spark, d):
    merged = rc.with_outbox(t.audit_log(spark, d).drop("k"), t.from_audit(spark, d, t.OUTBOX_SQL))
    return merged.select("tenant_id", "decision", "action", "actor_id", "event_uuid", "est_rows")


_IMPORT = """SELECT o_orderkey AS line, concat(' Word', CAST(o_custkey AS STRING)) AS word, CASE WHEN o_orderkey % 23 = 0 THEN '' ELSE o_orderpriority END AS description FROM orders"""
_KNOWN = "SELECT concat('word', CAST(c_custkey AS STRING)) AS key FROM customer WHERE c_mktsegment = 'BUILDING'"
_JUDGED = """judged AS (SELECT i.*, CASE WHEN line <> min(line) OVER (PARTITION BY lower(trim(word))) THEN 'duplicate in file' WHEN k.key IS NOT NULL THEN 'already exists' WHEN description = '' THEN 'invalid' END AS reason
 FROM imported i LEFT JOIN known k ON k.key = lower(trim(word)))"""


def _merge(spark, d):
    rows = t.select_over(spark, _IMPORT, "orders", t.load(spark, d, "orders"))
    known = t.select_over(spark, _KNOWN, "customer", t.load(spark, d, "customer"))
    return rc.bulk_merge(rows, known, F.lower(F.trim("word")), "line", F.col("description") != "")


@query("bulk_merge_inserts", with_ctes("SELECT line, word, description FROM judged WHERE reason IS NULL", f"imported AS ({_IMPORT})", f"known AS ({_KNOWN})", _JUDGED))
def bulk_merge_inserts(spark, d):
    return _merge(spark, d)[0].select("line", "word", "description")


@query("bulk_merge_rejects", with_ctes("SELECT line, reason FROM judged WHERE reason IS NOT NULL", f"imported AS ({_IMPORT})", f"known AS ({_KNOWN})", _JUDGED))
def bulk_merge_rejects(spark, d):
    return _merge(spark, d)[1].select("line", "reason")


def _copy(spark, d):
    """A copy of customer with lost, added and changed rows."""
    customer = t.load(spark, d, "customer")
    changed = customer.filter(F.col("c_custkey") % 29 != 0).withColumn(
        "c_name", F.when(F.col("c_custkey") % 31 == 0, F.lit("changed")).otherwise(F.col("c_name"))
    )
    return changed.unionByName(customer.filter(F.col("c_custkey") % 37 == 0).withColumn("c_custkey", F.col("c_custkey") + 10_000_000_000))


_CENTS = "(SELECT * REPLACE (CAST(c_acctbal AS DECIMAL(18, 2)) AS c_acctbal) FROM customer)"


@query("table_digests", f"""
SELECT 'customer' AS table_name, a.*, b.key_digest FROM (SELECT count(*) AS rows, {set_digest_sql()} AS digest FROM {digest_sql(_CUSTOMER, _CENTS)}) a,
 (SELECT {set_digest_sql()} AS key_digest FROM {digest_sql(['c_custkey'], 'customer')}) b""")
def table_digests(spark, d):
    """All columns, balances to the cent, and the keys alone."""
    customer = t.load(spark, d, "customer").withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(18,2)"))
    return rc.table_digests({"customer": (customer, ["c_custkey"])})


@query("compare_tables", """
SELECT 'customer' AS table_name, count(*) AS source_rows, count(*) FILTER (c_custkey % 29 <> 0) + count(*) FILTER (c_custkey % 37 = 0) AS target_rows, false AS same_content, false AS same_keys FROM customer
UNION ALL SELECT 'nation', count(*), count(*), true, true FROM nation""")
def compare_tables(spark, d):
    customer, nation = t.load(spark, d, "customer"), t.load(spark, d, "nation")
    return rc.compare_tables(
        {"customer": (customer, ["c_custkey"]), "nation": (nation, ["n_nationkey"])},
        {"customer": (_copy(spark, d), ["c_custkey"]), "nation": (nation.orderBy(F.desc("n_name")), ["n_nationkey"])},
    )


@query("differing_rows", """
SELECT c_custkey::VARCHAR AS c_custkey, CASE WHEN c_custkey % 29 = 0 THEN 'missing_in_target' ELSE 'different' END AS difference FROM customer WHERE c_custkey % 29 = 0 OR c_custkey % 31 = 0
UNION ALL SELECT (c_custkey + 10000000000)::VARCHAR, 'missing_in_source' FROM customer WHERE c_custkey % 37 = 0""")
def differing_rows(spark, d):
    return rc.differing_rows(t.load(spark, d, "customer"), _copy(spark, d), ["c_custkey"])


@query("orphan_references", """
SELECT o_orderkey, ref FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS ref FROM orders) WHERE ref IS NOT NULL AND ref NOT IN (SELECT c_custkey FROM customer)""")
def orphan_references(spark, d):
    ref = F.when(F.col("o_orderkey") % 13 == 0, None).when(F.col("o_orderkey") % 11 == 0, F.col("o_custkey") + 1_000_000).otherwise(F.col("o_custkey"))
    child = t.load(spark, d, "orders").select("o_orderkey", ref.alias("ref"))
    return rc.orphans(child, t.load(spark, d, "customer"), "ref", "c_custkey").select("o_orderkey", "ref")


NOW = dt.datetime(2024, 1, 31)


@query("retained_events", over_audit("""
SELECT id, agent_id FROM (SELECT id, agent_id, sum(est_rows + 1) OVER (ORDER BY ts DESC, id DESC) AS from_here FROM audit_log WHERE ts >= TIMESTAMP '2024-01-11')
WHERE from_here <= (SELECT sum(est_rows + 1) // 3 FROM audit_log)"""))
def retained_events(spark, d):
    log = t.audit_log(spark, d)
    cap = log.agg(F.sum(F.col("est_rows") + 1)).first()[0] // 3
    return rc.retain(log, NOW, dt.timedelta(days=20), cap, ["ts", "id"], F.col("est_rows") + 1).select("id", "agent_id")


@query("retained_cursors", over_audit("""
SELECT session_id, updated_at FROM (SELECT session_id, max(ts) AS updated_at FROM audit_log WHERE k % 5 = 0 GROUP BY 1) c
WHERE updated_at >= TIMESTAMP '2024-01-26' OR session_id IN (SELECT session_id FROM audit_log WHERE k % 3 = 0)"""))
def retained_cursors(spark, d):
    log = t.audit_log(spark, d)
    cursors = log.filter("k % 5 = 0").groupBy("session_id").agg(F.max("ts").alias("updated_at"))
    return rc.retain_cursors(cursors, log.filter("k % 3 = 0"), ["session_id"], NOW, dt.timedelta(days=5))
