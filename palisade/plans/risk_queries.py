"""Risk rules over the derived signal log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.operators import policy as p
from palisade.operators import risk as rk
from palisade.plans.audit_queries import AGENTS
from palisade.plans.policy_queries import _LOG_TABLES, _RESOLVED, _VERDICTS, POLICIES, REFUSED_COLUMNS
from palisade.plans.registry import over_audit, over_signals, query
from palisade.sources import tables as t

_META = """SELECT * FROM (VALUES ('sales.orders', true, CAST(90000 AS BIGINT)), ('sales.lineitem', false, CAST(600000 AS BIGINT)),
 ('sales.customer', true, CAST(1500 AS BIGINT)), ('events', true, CAST(100001 AS BIGINT))) AS m(table_name, has_index, row_count)"""


_BURSTS = "SELECT id, tenant_id, agent_id, ts, latency_ms * 60000 AS latency_ms FROM audit_log"
_QPS, _SLOTS = 0.0005, 2
_BUCKET = (
    f"bursts AS ({_BURSTS})",
    "turns AS (SELECT *, epoch_us(ts)::DOUBLE / 1e6 AS at_s, row_number() OVER (PARTITION BY tenant_id, agent_id ORDER BY ts, id) AS n FROM bursts)",
    f"""bucket(tenant_id, agent_id, id, n, tokens, last, ends, reason) AS (
 SELECT tenant_id, agent_id, id, n, 0.0::DOUBLE, at_s, [at_s + latency_ms / 1000.0::DOUBLE], '' FROM turns WHERE n = 1
 UNION ALL SELECT tenant_id, agent_id, id, n, CASE WHEN reason = '' THEN filled - 1 ELSE filled END, at_s, CASE WHEN reason = '' THEN list_append(open_ends, at_s + latency_ms / 1000.0::DOUBLE) ELSE open_ends END, reason
 FROM (SELECT *, CASE WHEN len(open_ends) >= {_SLOTS} THEN 'concurrency' WHEN filled < 1 THEN 'qps' ELSE '' END AS reason FROM (
  SELECT t.tenant_id, t.agent_id, t.id, t.n, t.at_s, t.latency_ms, least(1.0::DOUBLE, b.tokens + (t.at_s - b.last) * {_QPS}::DOUBLE) AS filled, list_filter(b.ends, lambda e: e > t.at_s) AS open_ends
  FROM bucket b JOIN turns t ON t.tenant_id = b.tenant_id AND t.agent_id = b.agent_id AND t.n = b.n + 1)))""",
)


def _recursive(sql: str) -> str:
    return sql.replace("WITH audit_log", "WITH RECURSIVE audit_log", 1)


@query("rate_limits", _recursive(over_audit("SELECT id, reason AS limit_reason FROM bucket", *_BUCKET)))
def rate_limits(spark, d):
    return rk.rate_limits(t.from_audit(spark, d, _BURSTS), _QPS, _SLOTS).select("id", "limit_reason")


def metadata(spark) -> DataFrame:
    return spark.sql(_META)


def facts(spark, d) -> DataFrame:
    """Signals with every fact a rule may ask for."""
    limited = rk.rate_limits(t.from_audit(spark, d, _BURSTS), _QPS, _SLOTS).filter("limit_reason <> ''").select("id")
    return rk.with_facts(t.query_signals(spark, d), t.agents(spark, d), p.resolve_policies(t.policies(spark, d)), metadata(spark), limited)


_FACTS = f"""meta AS ({_META}), table_facts AS (SELECT u.id, bool_or(NOT coalesce(has_index, false)) AS unindexed, max(row_count) AS largest, bool_or(row_count IS NULL) AS unsized
  FROM uses u LEFT JOIN meta USING (table_name_key) GROUP BY 1)""".replace("USING (table_name_key)", "ON meta.table_name = u.object_name")
_REFUSED = f"refused AS (SELECT id, bool_or(no) AS access_refused FROM (SELECT id, NOT (NOT bool_or(denied) AND bool_and(allowed)) AS no FROM verdicts GROUP BY 1 UNION ALL SELECT id, true FROM ({REFUSED_COLUMNS}) c) GROUP BY 1)"
_WRITE = "stmt_type IN ('UPDATE', 'DELETE')"
_RULES = {
    "R001": "is_multi",
    "R002": f"{_WRITE} AND (NOT has_where OR where_tautology)",
    "R003": "level = 'readonly' AND stmt_type <> 'SELECT'",
    "R004": "est_scan_rows > 100000",
    "R005": "stmt_type = 'SELECT' AND (truncated OR (NOT has_limit AND NOT (is_pure_aggregate AND NOT has_group_by) AND est_scan_rows > 1000))",
    "R006": "is_multi OR operation_1 = 'SQL_COMMENT'",
    "R007": "(dialect = 'postgres' AND function_1 = 'pg_sleep') OR (dialect = 'mysql' AND function_1 = 'sleep')",
    "R008": "rate_limited",
    "R009": "(operation_1 LIKE 'NESTING_DEPTH:%' OR operation_1 LIKE 'UNION_COUNT:%') AND k > 16",
    "R010": "access_refused",
    "R101": "dialect = 'postgres' AND operation_1 = 'DROP TABLE'",
    "R102": "dialect = 'postgres' AND operation_1 = 'REINDEX'",
    "R103": "dialect = 'postgres' AND function_1 = 'pg_catalog.pg_read_file'",
    "R104": "dialect = 'postgres' AND operation_1 = 'COPY PROGRAM'",
    "R105": f"dialect = 'postgres' AND {_WRITE} AND unindexed",
    "R106": "dialect = 'postgres' AND operation_1 = 'ALTER TABLE' AND (unsized OR largest > 100000)",
    "R107": "dialect = 'postgres' AND in_transaction AND (tx_idle_ms > 5000 OR tx_age_ms > 5000)",
    "R201": "dialect = 'mysql' AND operation_1 = 'LOAD_FILE'",
    "R202": f"dialect = 'mysql' AND {_WRITE} AND (table_2 IS NOT NULL OR NOT has_limit)",
    "R203": "dialect = 'mysql' AND operation_1 = 'SET GLOBAL'",
    "R204": "dialect = 'mysql' AND in_transaction AND (tx_age_ms > 5000 OR tx_affected_rows > 100000)",
}
_LEVELS = {r: rk.RULE_LEVELS[r] for r in _RULES}
_HITS = "hits AS (SELECT s.*, list_filter([" + ", ".join(
    f"CASE WHEN coalesce({text}, false) THEN '{rule}' END" for rule, text in _RULES.items()
) + "], lambda x: x IS NOT NULL) AS rules FROM (SELECT s.*, level, unindexed, largest, unsized, access_refused, rate_limited FROM signals s LEFT JOIN agents g USING (tenant_id, agent_id) LEFT JOIN table_facts f USING (id) LEFT JOIN refused r USING (id) LEFT JOIN (SELECT id, reason <> '' AS rate_limited FROM bucket) USING (id)) s)"
_CTES = (AGENTS, POLICIES, _RESOLVED, _LOG_TABLES, _VERDICTS, _FACTS, _REFUSED, *_BUCKET, _HITS)
_LEVEL_ROWS = "levels(rule_id, decision, rank) AS (VALUES " + ", ".join(
    f"('{r}', '{d}', {rk.PRIORITY[d] * 100 + 99 - i})" for i, (r, d) in enumerate(rk.RULE_LEVELS.items())
) + ")"
_INVALID = "(level IS NULL)"


@query("risk_hits", _recursive(over_signals("SELECT id, array_to_string(rules, ',') AS rules FROM hits", *_CTES)))
def risk_hits(spark, d):
    return rk.assess(facts(spark, d)).select("id", F.array_join(F.transform("hits", lambda h: h["rule_id"]), ",").alias("rules"))


@query("risk_verdicts", _recursive(over_signals(f"""
SELECT h.id, CASE WHEN {_INVALID} THEN 'deny' ELSE coalesce(top.decision, 'allow') END AS decision,
 CASE CASE WHEN {_INVALID} THEN 'deny' ELSE coalesce(top.decision, 'allow') END WHEN 'deny' THEN 1 WHEN 'approve' THEN 2 WHEN 'warn' THEN 3 ELSE 4 END AS risk,
 CASE WHEN NOT {_INVALID} THEN top.rule_id END AS reason_rule, {_INVALID} AS failed_closed
FROM hits h LEFT JOIN (SELECT id, max_by(decision, rank) AS decision, max_by(rule_id, rank) AS rule_id FROM (SELECT id, unnest(rules) AS rule_id FROM hits) JOIN levels USING (rule_id) GROUP BY 1) top USING (id)""", *_CTES, _LEVEL_ROWS)))
def risk_verdicts(spark, d):
    return rk.assess(facts(spark, d)).select("id", "decision", "risk", "reason_rule", "failed_closed")


@query("risk_rule_counts", _recursive(over_signals("""
SELECT rule_id, dialect, count(*) AS n FROM (SELECT dialect, unnest(rules) AS rule_id FROM hits) GROUP BY 1, 2""", *_CTES)))
def risk_rule_counts(spark, d):
    hits = rk.assess(facts(spark, d)).select("dialect", F.explode("hits").alias("h"))
    return hits.groupBy("h.rule_id", "dialect").agg(F.count(F.lit(1)).alias("n"))


_LAYERS = """SELECT 'global' AS layer, '' AS scope_id, concat('R00', CAST(n_nationkey AS STRING)) AS rule_id, n_nationkey <> 9 AS enabled, false AS explicit_deny, 'max_scan_rows' AS name, 60000.0 AS value FROM nation WHERE n_nationkey IN (4, 5, 9)
 UNION ALL SELECT 'datasource', concat('ds-', CAST(n_regionkey AS STRING)), 'R005', n_nationkey % 2 = 0, false, 'row_limit', 20000.0 + n_regionkey * 5000 FROM nation WHERE n_nationkey < 5
 UNION ALL SELECT 'agent', concat('agent-', CAST(n_nationkey AS STRING)), CASE n_nationkey % 3 WHEN 0 THEN 'R009' WHEN 1 THEN 'R004' ELSE 'R005' END, CASE WHEN n_nationkey % 4 = 0 THEN CAST(NULL AS BOOLEAN) ELSE n_nationkey % 5 <> 0 END, n_nationkey % 11 = 3,
  CASE n_nationkey % 3 WHEN 0 THEN 'max_nesting_depth' WHEN 1 THEN 'max_scan_rows' ELSE 'row_limit' END, CAST(30000 + n_nationkey AS DOUBLE) FROM nation"""


def _layers(spark, d):
    flat = t.select_over(spark, _LAYERS, "nation", t.load(spark, d, "nation"))
    return flat.withColumn("thresholds", F.create_map("name", F.col("value").cast("double"))).drop("name", "value")


_SETTINGS = """targets AS (SELECT DISTINCT agent_id, datasource_id FROM audit_log),
 met AS (SELECT t.*, l.rule_id, l.enabled, l.explicit_deny, l.name, l.value, CASE l.layer WHEN 'global' THEN 1 WHEN 'datasource' THEN 2 ELSE 3 END AS rank
  FROM targets t JOIN layers l ON (l.layer = 'global') OR (l.layer = 'datasource' AND l.scope_id = t.datasource_id) OR (l.layer = 'agent' AND l.scope_id = t.agent_id)),
 settings AS (SELECT agent_id, datasource_id, rule_id, bool_or(explicit_deny) OR coalesce(max_by(enabled, rank) FILTER (enabled IS NOT NULL), true) AS enabled, bool_or(explicit_deny) AS explicit_deny FROM met GROUP BY 1, 2, 3),
 limits AS (SELECT agent_id, datasource_id, rule_id, name, max_by(value, rank)::DOUBLE AS value FROM met GROUP BY 1, 2, 3, 4)"""


@query("resolve_rule_config", over_audit("""
SELECT agent_id, datasource_id, rule_id, enabled, explicit_deny, (SELECT sum(value) FROM limits l WHERE (l.agent_id, l.datasource_id, l.rule_id) = (s.agent_id, s.datasource_id, s.rule_id)) AS thresholds
FROM settings s""", f"layers AS ({_LAYERS})", _SETTINGS))
def resolve_rule_config(spark, d):
    config = rk.resolve_config(t.audit_log(spark, d), _layers(spark, d))
    rows = config.select("agent_id", "datasource_id", F.explode("config").alias("rule_id", "s"))
    return rows.select(
        "agent_id", "datasource_id", "rule_id", "s.enabled", "s.explicit_deny", F.aggregate(F.map_values("s.thresholds"), F.lit(0.0), lambda a, v: a + v).alias("thresholds")
    )


_CONFIGURED = {
    "R004": "CASE WHEN x4 THEN true WHEN coalesce(e4, true) THEN coalesce(est_scan_rows > coalesce(l4, 100000), false) ELSE false END",
    "R005": "CASE WHEN x5 THEN true WHEN coalesce(e5, true) THEN coalesce(stmt_type = 'SELECT' AND (truncated OR (NOT has_limit AND NOT (is_pure_aggregate AND NOT has_group_by) AND est_scan_rows > coalesce(l5, 1000))), false) ELSE false END",
    "R009": "CASE WHEN x9 THEN true WHEN coalesce(e9, true) THEN coalesce((operation_1 LIKE 'NESTING_DEPTH:%' AND k > coalesce(l9, 16)) OR (operation_1 LIKE 'UNION_COUNT:%' AND k > 16), false) ELSE false END",
}
_PIVOT = "pivoted AS (SELECT s.*, " + ", ".join(
    f"c{n}.enabled AS e{n}, coalesce(c{n}.explicit_deny, false) AS x{n}, l{n}.value AS l{n}" for n in (4, 5, 9)
) + " FROM signals s " + " ".join(
    f"LEFT JOIN settings c{n} ON c{n}.agent_id = s.agent_id AND c{n}.datasource_id = s.datasource_id AND c{n}.rule_id = 'R00{n}' "
    f"LEFT JOIN limits l{n} ON l{n}.agent_id = s.agent_id AND l{n}.datasource_id = s.datasource_id AND l{n}.rule_id = 'R00{n}' AND l{n}.name = '{name}'"
    for n, name in ((4, "max_scan_rows"), (5, "row_limit"), (9, "max_nesting_depth"))
) + ")"


@query("configured_hits", over_signals(f"""
SELECT id, {_CONFIGURED['R004']} AS r004, {_CONFIGURED['R005']} AS r005, {_CONFIGURED['R009']} AS r009 FROM pivoted""", f"layers AS ({_LAYERS})", _SETTINGS, _PIVOT))
def configured_hits(spark, d):
    signals = rk.with_agents(t.query_signals(spark, d), t.agents(spark, d))
    config = rk.resolve_config(signals, _layers(spark, d))
    assessed = rk.assess(signals.join(config, ["agent_id", "datasource_id"], "left"))
    ids = F.transform("hits", lambda h: h["rule_id"])
    return assessed.select("id", *[F.array_contains(ids, r).alias(r.lower()) for r in _CONFIGURED])


_LABELLED = """SELECT dialect, rule_id, expected, CASE WHEN id % 97 = 0 THEN NOT expected ELSE expected END AS actual FROM (
 SELECT id, dialect, 'R002' AS rule_id, stmt_type IN ('UPDATE', 'DELETE') AND (NOT has_where OR where_tautology) AS expected FROM signals
 UNION ALL SELECT id * 97 + 1, dialect, 'R001', is_multi FROM signals) AS each_case"""


@query("rule_quality", over_signals("""
SELECT *, misses = 0 AND coalesce(false_positive_rate, 0) < 0.02 AS ok FROM (SELECT rule_id, dialect, count(*) AS cases, count(*) FILTER (expected AND NOT actual) AS misses, count(*) FILTER (NOT expected AND actual) AS false_positives,
 CASE WHEN count(*) FILTER (NOT expected) > 0 THEN count(*) FILTER (NOT expected AND actual) / (count(*) FILTER (NOT expected))::DOUBLE END AS false_positive_rate FROM labelled GROUP BY 1, 2)""", f"labelled AS ({_LABELLED})"))
def rule_quality(spark, d):
    return rk.rule_quality(t.select_over(spark, _LABELLED, "signals", t.query_signals(spark, d)))

