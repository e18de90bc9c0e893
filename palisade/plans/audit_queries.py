"""Audit analytics over the derived audit log."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from palisade.operators import audit
from palisade.plans.registry import CHECK_SQL, over_audit, query
from palisade.session import materialize, scratch_path
from palisade.sources import versions
from palisade.sources import tables as t

WINDOW = audit.DayWindow(14, dt.datetime(2024, 1, 30, 12))
_IN = "ts >= TIMESTAMP '2024-01-17' AND ts < TIMESTAMP '2024-01-31'"
_BOTH = "ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-31'"
AGENTS = f"agents AS ({t.AGENTS_SQL})"
SOURCES = f"datasources AS ({t.DATASOURCES_SQL})"
APPROVALS = f"approvals AS ({t.APPROVALS_SQL})"
OUTBOX = f"outbox AS ({t.OUTBOX_SQL})"
TEXTS = f"texts AS ({t.SQL_TEXT_SQL})"
NOW = dt.datetime(2024, 1, 31)

FILTER = audit.AuditFilter(
    time_start=dt.datetime(2024, 1, 5), time_end=dt.datetime(2024, 1, 25), actor="agent-7",
    decisions=("deny", "warn", "approve"), stmt_types=("INSERT", "UPDATE", "DELETE"), rule_like="r00",
)


@query("audit_filter", over_audit("""
SELECT id, tenant_id, agent_id, decision, stmt_type FROM audit_log
WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-25' AND agent_id = 'agent-7'
 AND decision IN ('deny','warn','approve') AND stmt_type IN ('INSERT','UPDATE','DELETE')
 AND contains(lower(rule_hits), 'r00')"""))
def audit_filter(spark, d):
    return audit.filter_audit(t.audit_log(spark, d), FILTER).select("id", "tenant_id", "agent_id", "decision", "stmt_type")


@query("audit_page", over_audit("SELECT id, ts, decision FROM audit_log ORDER BY ts DESC, id DESC LIMIT 50 OFFSET 100"))
def audit_page(spark, d):
    return audit.page(t.audit_log(spark, d), 3, 50).select("id", "ts", "decision")


@query("audit_keyset_page", over_audit("""
SELECT id, ts, decision FROM audit_log WHERE ts < TIMESTAMP '2024-01-20' ORDER BY ts DESC, id DESC LIMIT 50"""))
def audit_keyset_page(spark, d):
    return audit.page_after(t.audit_log(spark, d), dt.datetime(2024, 1, 20), -1, 50).select("id", "ts", "decision")


# A tenant for each region: agents and an open approval, but no request in any window.
_QUIET_SQL = "SELECT concat('quiet-', CAST(r_regionkey AS STRING)) AS tenant_id FROM region"
QUIET = f"quiet AS ({_QUIET_SQL})"


def _quiet(spark, d):
    return t.select_over(spark, _QUIET_SQL, "region", t.load(spark, d, "region"))


@query("audit_kpi", over_audit(f"""
SELECT tenant_id, coalesce(total_requests, 0) AS total_requests, coalesce(blocked, 0) AS blocked, coalesce(pending_approvals, 0) AS pending_approvals,
 coalesce(active_agents, 0) AS active_agents, coalesce(datasources_total, 0) AS datasources_total,
 round(CASE WHEN pt <> 0 THEN (total_requests - pt) / pt::DOUBLE * 100 END, 6) AS total_requests_delta,
 round(CASE WHEN pb <> 0 THEN (blocked - pb) / pb::DOUBLE * 100 END, 6) AS blocked_delta
FROM (SELECT tenant_id, count(*) FILTER (ts >= TIMESTAMP '2024-01-17') AS total_requests,
  count(*) FILTER (ts >= TIMESTAMP '2024-01-17' AND decision = 'deny') AS blocked,
  count(*) FILTER (ts < TIMESTAMP '2024-01-17') AS pt,
  count(*) FILTER (ts < TIMESTAMP '2024-01-17' AND decision = 'deny') AS pb
  FROM audit_log WHERE {_BOTH} GROUP BY 1) c
FULL JOIN (SELECT tenant_id, count(*) FILTER (status = 'pending') AS pending_approvals FROM (SELECT tenant_id, status FROM approvals UNION ALL SELECT tenant_id, 'pending' FROM quiet) GROUP BY 1) p USING (tenant_id)
FULL JOIN (SELECT tenant_id, count(*) FILTER (status = 'active') AS active_agents FROM (SELECT tenant_id, status FROM agents UNION ALL SELECT tenant_id, 'active' FROM quiet) GROUP BY 1) a USING (tenant_id)
FULL JOIN (SELECT tenant_id, count(*) AS datasources_total FROM datasources GROUP BY 1) s USING (tenant_id)
""", AGENTS, SOURCES, APPROVALS, QUIET))
def audit_kpi(spark, d):
    quiet = _quiet(spark, d)
    out = audit.kpi(
        t.audit_log(spark, d),
        t.from_audit(spark, d, t.APPROVALS_SQL).select("tenant_id", "status").unionByName(quiet.withColumn("status", F.lit("pending"))),
        t.agents(spark, d).select("tenant_id", "status").unionByName(quiet.withColumn("status", F.lit("active"))),
        t.datasources(spark, d), WINDOW,
    )
    return out.withColumns({c: F.round(c, 6) for c in ("total_requests_delta", "blocked_delta")})


@query("audit_trend", over_audit(f"""
SELECT c.tenant_id, strftime(c.day, '%Y-%m-%d') AS day, count(a.id) AS total,
 count(*) FILTER (decision = 'deny') AS deny, count(*) FILTER (decision = 'warn') AS warn,
 count(*) FILTER (decision = 'approve') AS approve, count(*) FILTER (decision = 'allow') AS allow
FROM (SELECT tenant_id, unnest(generate_series(DATE '2024-01-17', DATE '2024-01-30', INTERVAL 1 DAY))::DATE AS day
      FROM (SELECT DISTINCT tenant_id FROM agents)) c
LEFT JOIN audit_log a ON a.tenant_id = c.tenant_id AND a.ts::DATE = c.day
GROUP BY 1, 2""", AGENTS))
def audit_trend(spark, d):
    return audit.trend(t.audit_log(spark, d), t.agents(spark, d), WINDOW)


@query("decision_distribution", over_audit(f"""
SELECT f.tenant_id, f.decision, count(a.id) AS n
FROM (SELECT tenant_id, unnest(['allow','deny','approve','warn']) AS decision FROM (SELECT DISTINCT tenant_id FROM agents)) f
LEFT JOIN (SELECT * FROM audit_log WHERE {_IN}) a USING (tenant_id, decision) GROUP BY 1, 2""", AGENTS))
def decision_distribution(spark, d):
    return audit.decision_distribution(t.audit_log(spark, d), t.agents(spark, d), WINDOW)


_HIT_ROWS = """hits AS (SELECT tenant_id, ts, unnest(from_json(rule_hits, '[{"RuleID":"VARCHAR","Decision":"VARCHAR"}]')) AS h
 FROM audit_log WHERE rule_hits IS NOT NULL)"""


@query("risk_top", over_audit(f"""
SELECT tenant_id, rule_id, n FROM (
 SELECT tenant_id, h.RuleID AS rule_id, count(*) AS n,
  row_number() OVER (PARTITION BY tenant_id ORDER BY count(*) DESC, h.RuleID) AS rk
 FROM hits WHERE {_IN} AND h.Decision <> 'allow' GROUP BY 1, 2) WHERE rk <= 5""", _HIT_ROWS))
def risk_top(spark, d):
    return audit.risk_top(t.audit_log(spark, d), WINDOW)


@query("risk_top_sketched", CHECK_SQL["risk_top"])
def risk_top_sketched(spark, d):
    """The same from fourteen days of stored sketches; the log is read for each day once."""
    sketches = materialize(audit.rule_sketches(t.audit_log(spark, d)), "rule-sketches")
    return audit.top_of_sketches(sketches.filter((F.col("day") >= "2024-01-17") & (F.col("day") < "2024-01-31")))


@query("agent_ranking", over_audit(f"""
SELECT r.tenant_id, r.agent_id, blocked_count, coalesce(name, '') AS name FROM (
 SELECT tenant_id, agent_id, count(*) AS blocked_count,
  row_number() OVER (PARTITION BY tenant_id ORDER BY count(*) DESC, agent_id) AS rk
 FROM audit_log WHERE {_IN} AND decision = 'deny' GROUP BY 1, 2) r
LEFT JOIN agents USING (tenant_id, agent_id) WHERE rk <= 5""", AGENTS))
def agent_ranking(spark, d):
    return audit.agent_ranking(t.audit_log(spark, d), t.agents(spark, d), WINDOW)


@query("blocked_savings", over_audit(f"""
SELECT tenant_id, count(*) FILTER (decision = 'deny') AS blocked_count,
 coalesce(sum(est_rows) FILTER (decision = 'deny'), 0)::BIGINT AS est_rows_saved
FROM audit_log WHERE {_IN} GROUP BY 1 UNION ALL SELECT tenant_id, 0, 0 FROM quiet""", QUIET))
def blocked_savings(spark, d):
    tenants = t.agents(spark, d).select("tenant_id").unionByName(_quiet(spark, d))
    return audit.blocked_savings(t.audit_log(spark, d), tenants, WINDOW)


@query("report_summary", over_audit("""
SELECT 'total' AS section, '' AS key, count(*) AS n, min(ts) AS since, max(ts) AS until FROM audit_log
UNION ALL SELECT 'action', '<none>', count(*), min(ts), max(ts) FROM audit_log
UNION ALL SELECT 'status', CASE WHEN decision = 'error' THEN 'error' ELSE 'success' END, count(*), min(ts), max(ts)
 FROM audit_log GROUP BY 2"""))
def report_summary(spark, d):
    return audit.report_summary(t.audit_log(spark, d))


@query("report_summary_lines", over_audit("""
SELECT 'action' AS section, '<none>=' || count(*) AS line FROM audit_log
UNION ALL SELECT 'status', CASE WHEN decision = 'error' THEN 'error' ELSE 'success' END || '=' || count(*)
 FROM audit_log GROUP BY decision = 'error'"""))
def report_summary_lines(spark, d):
    return audit.summary_lines(audit.report_summary(t.audit_log(spark, d)))


@query("top_error_codes", over_audit("""
SELECT error_code AS value, count(*) AS n FROM audit_log WHERE error_code IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""))
def top_error_codes(spark, d):
    return audit.top_counts(t.audit_log(spark, d), "error_code", 10)


@query("top_actors", over_audit("""
SELECT agent_id AS value, count(*) AS n FROM audit_log GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""))
def top_actors(spark, d):
    log = t.audit_log(spark, d)
    return audit.top_counts(log, audit.actor(log), 10)


@query("audit_status", over_audit("""
SELECT CASE WHEN decision = 'error' THEN 'error' ELSE 'success' END AS status, decision, count(*) AS n
FROM audit_log GROUP BY 1, 2"""))
def audit_status(spark, d):
    return audit.with_status(t.audit_log(spark, d)).groupBy("status", "decision").agg(F.count(F.lit(1)).alias("n"))


@query("error_categories", over_audit("""
SELECT CASE WHEN error_code IN ('DB_QUERY_TIMEOUT', 'DB_SYNTAX_ERROR') THEN error_code
  WHEN error_msg LIKE '%refused%' THEN 'connect_error' WHEN error_msg LIKE '%DEADLINE%' THEN 'timeout'
  WHEN error_msg IS NOT NULL OR decision = 'error' THEN 'unknown' END AS category, count(*) AS n
FROM texts GROUP BY 1""", TEXTS))
def error_categories(spark, d):
    texts = t.from_audit(spark, d, t.SQL_TEXT_SQL)
    category = audit.error_category(F.col("error_code"), F.col("error_msg"), F.col("decision"))
    return texts.groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("hit_rule_ids", over_audit("""
SELECT id, coalesce(array_to_string(list_transform(from_json(rule_hits, '[{"RuleID":"VARCHAR"}]'), lambda x: x.RuleID), ','), '') AS rule_ids
FROM audit_log"""))
def hit_rule_ids(spark, d):
    return t.audit_log(spark, d).select("id", F.array_join(audit.rule_ids(F.col("rule_hits")), ",").alias("rule_ids"))


@query("alert_payload", over_audit("""
SELECT a.tenant_id, id AS audit_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS timestamp, decision,
 coalesce(array_to_string(list_transform(from_json(rule_hits, '[{"RuleID":"VARCHAR"}]'), lambda x: x.RuleID), ','), '') AS rule_ids,
 a.datasource_id, s.name AS datasource_name, a.agent_id, g.name AS agent_name, stmt_type, est_rows, latency_ms,
 CASE WHEN error_code IS NOT NULL THEN error_code WHEN decision = 'error' THEN 'unknown' END AS error_code
FROM audit_log a LEFT JOIN agents g ON g.tenant_id = a.tenant_id AND g.agent_id = a.agent_id
LEFT JOIN datasources s ON s.tenant_id = a.tenant_id AND s.datasource_id = a.datasource_id""", AGENTS, SOURCES))
def alert_payload(spark, d):
    return audit.alert_payload(t.audit_log(spark, d), t.agents(spark, d), t.datasources(spark, d))


@query("intent_rows", over_audit("""
SELECT tenant_id, details_json LIKE '%"audit_phase":"intent"%' AS intent, count(*) AS n FROM outbox GROUP BY 1, 2""", OUTBOX))
def intent_rows(spark, d):
    outbox = t.from_audit(spark, d, t.OUTBOX_SQL)
    return outbox.groupBy("tenant_id", audit.is_intent(F.col("details_json")).alias("intent")).agg(F.count(F.lit(1)).alias("n"))


@query("unsafe_details", over_audit("""
SELECT event_uuid, details_json LIKE '%password%' OR details_json LIKE '{broken%' OR details_json LIKE '%postgres://%' AS unsafe
FROM outbox""", OUTBOX))
def unsafe_details(spark, d):
    return t.from_audit(spark, d, t.OUTBOX_SQL).select("event_uuid", audit.unsafe_details(F.col("details_json")).alias("unsafe"))


@query("outbox_stats", over_audit("""
SELECT tenant_id, count(*) AS pending, count(*) FILTER (attempts > 0) AS retrying,
 CAST(epoch(TIMESTAMP '2024-01-31') AS BIGINT) - CAST(floor(epoch(min(created_at))) AS BIGINT) AS oldest_age_s,
 CASE WHEN epoch(TIMESTAMP '2024-01-31') - floor(epoch(min(created_at))) > 1800 THEN 'critical'
      WHEN epoch(TIMESTAMP '2024-01-31') - floor(epoch(min(created_at))) > 300 THEN 'warn' ELSE 'ok' END AS level
FROM outbox WHERE delivered_at IS NULL GROUP BY 1""", OUTBOX))
def outbox_stats(spark, d):
    return audit.outbox_stats(t.from_audit(spark, d, t.OUTBOX_SQL), NOW)


@query("approvals_page", over_audit("""
SELECT id, tenant_id, agent_id, created_at, status FROM approvals WHERE status = 'pending'
ORDER BY created_at DESC, id DESC LIMIT 50""", APPROVALS))
def approvals_page(spark, d):
    return audit.approvals_page(t.from_audit(spark, d, t.APPROVALS_SQL), "pending", 50)


@query("counter_families", over_audit("""
SELECT 'requests' AS family, concat_ws('|', decision, datasource_id, stmt_type) AS labels, count(*) AS n FROM audit_log GROUP BY 2
UNION ALL SELECT 'rule_hits', concat_ws('|', h.RuleID, h.Decision), count(*) FROM hits GROUP BY 2""", _HIT_ROWS))
def counter_families(spark, d):
    return audit.counters(t.audit_log(spark, d))


@query("latency_histogram", over_audit("""
SELECT stmt_type, le, count(*) FILTER (le = '+Inf' OR latency_ms / 1000.0 <= TRY_CAST(le AS DOUBLE)) AS n,
 round(sum(latency_ms / 1000.0), 6) AS latency_sum
FROM (SELECT stmt_type, latency_ms, unnest(['0.001','0.0025','0.005','0.01','0.025','0.05','0.1','0.25','0.5','1.0','2.5','5.0','+Inf']) AS le
      FROM audit_log) GROUP BY 1, 2"""))
def latency_histogram(spark, d):
    seconds = F.col("latency_ms").cast("double") / 1000
    out = audit.latency_histogram(t.audit_log(spark, d), seconds, ["stmt_type"])
    return out.withColumn("latency_sum", F.round("latency_sum", 6))


@query("latency_percentiles", over_audit("""
SELECT stmt_type, percentile_disc(0.5) WITHIN GROUP (ORDER BY latency_ms) AS p50,
 percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms) AS p95, percentile_disc(0.99) WITHIN GROUP (ORDER BY latency_ms) AS p99,
 percentile_disc(0.999) WITHIN GROUP (ORDER BY latency_ms) AS p999 FROM audit_log GROUP BY 1"""))
def latency_percentiles(spark, d):
    return audit.latency_percentiles(t.audit_log(spark, d), "latency_ms", ["stmt_type"])


@query("distribution_check", over_audit("""
SELECT decision, agent_id, coalesce(a.n, 0) AS actual, coalesce(e.n, 0) AS expected
FROM (SELECT decision, agent_id, count(*) AS n FROM audit_log GROUP BY 1, 2) a
FULL JOIN (SELECT decision, agent_id, count(*) AS n FROM audit_log WHERE k % 10 <> 0 GROUP BY 1, 2) e USING (decision, agent_id)
WHERE coalesce(a.n, 0) <> coalesce(e.n, 0)"""))
def distribution_check(spark, d):
    """Counts of the whole log against a log that lost every tenth kind of row."""
    log = t.audit_log(spark, d)
    expected = log.filter(F.col("k") % 10 != 0).groupBy("decision", "agent_id").agg(F.count(F.lit(1)).alias("expected"))
    return audit.check_distribution(log, expected, ["decision", "agent_id"])


@query("verification_lag", over_audit("""
SELECT datasource_id, CAST(epoch(TIMESTAMP '2024-01-31') AS BIGINT) - CAST(floor(epoch(max(ts))) AS BIGINT) AS age_s,
 (CAST(epoch(TIMESTAMP '2024-01-31') AS BIGINT) - CAST(floor(epoch(max(ts))) AS BIGINT)) * 100 > 1200 * 120 AS lagging
FROM audit_log GROUP BY 1"""))
def verification_lag(spark, d):
    last = t.audit_log(spark, d).groupBy("datasource_id").agg(F.max("ts").alias("last_verified"))
    return audit.verification_lag(last, NOW, 1200).drop("last_verified")


@query("query_shapes", over_audit(r"""
SELECT trim(regexp_replace(regexp_replace(sql_raw, '''(?:[^'']|'''')*''|\b[0-9]+(?:\.[0-9]+)?\b', '?', 'g'), '\s+', ' ', 'g')) AS sql_shape,
 count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen, count(DISTINCT agent_id) AS agents
FROM texts GROUP BY 1""", TEXTS))
def query_shapes(spark, d):
    return audit.query_shapes(t.from_audit(spark, d, t.SQL_TEXT_SQL))


# Statement kinds stand for session states; these are the steps a session may take.
_EDGES = (("SELECT", "INSERT"), ("INSERT", "SELECT"), ("SELECT", "UPDATE"), ("UPDATE", "SELECT"))


@query("invalid_transitions", over_audit("""
SELECT session_id, id, stmt_type, prev AS prev_stmt_type FROM (
 SELECT *, lag(stmt_type) OVER (PARTITION BY session_id ORDER BY ts, id) AS prev FROM audit_log)
WHERE prev IS NOT NULL AND prev <> stmt_type
 AND (prev, stmt_type) NOT IN (('SELECT','INSERT'), ('INSERT','SELECT'), ('SELECT','UPDATE'), ('UPDATE','SELECT'))"""))
def invalid_transitions(spark, d):
    edges = spark.createDataFrame(list(_EDGES), "from_state string, to_state string")
    out = audit.invalid_transitions(t.audit_log(spark, d), edges, ["session_id"], ["ts", "id"], "stmt_type")
    return out.select("session_id", "id", "stmt_type", "prev_stmt_type")


_OPEN = """SELECT id, tenant_id, ts + INTERVAL 30 MINUTE AS idle_deadline, ts + INTERVAL 8 HOUR AS wall_deadline,
 CASE WHEN k % 5 = 0 THEN 'TERMINAL' WHEN k % 5 = 1 THEN 'ACTIVE' ELSE 'READY' END AS status FROM audit_log"""


@query("expired_sessions", over_audit("""
SELECT id, tenant_id, status FROM open_rows WHERE status <> 'TERMINAL' AND (wall_deadline <= TIMESTAMP '2024-01-15' OR idle_deadline <= TIMESTAMP '2024-01-15')
ORDER BY wall_deadline, id LIMIT 1000""", f"open_rows AS ({_OPEN})"))
def expired_sessions(spark, d):
    rows = t.from_audit(spark, d, _OPEN)
    return audit.expired(rows, ["wall_deadline", "idle_deadline"], dt.datetime(2024, 1, 15), 1000).select("id", "tenant_id", "status")


@query("session_state_counts", over_audit(
    "SELECT tenant_id, status, count(*) AS n FROM open_rows GROUP BY 1, 2", f"open_rows AS ({_OPEN})"))
def session_state_counts(spark, d):
    return audit.state_counts(t.from_audit(spark, d, _OPEN))


@query("tenant_rows", over_audit("SELECT decision, count(*) AS n FROM audit_log WHERE tenant_id = 't0' GROUP BY 1"))
def tenant_rows(spark, d):
    return audit.for_tenant(t.audit_log(spark, d), "t0").groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


@query("tenant_layout", over_audit("SELECT ts::DATE AS day, decision, count(*) AS n FROM audit_log WHERE tenant_id = 't0' AND ts::DATE >= DATE '2024-01-10' GROUP BY 1, 2"))
def tenant_layout(spark, d):
    """One tenant's later days from a log that is laid out by tenant and day: no other file is opened."""
    log, path = t.audit_log(spark, d), scratch_path(spark, "tenant-layout")
    versions.write_by_tenant(log, path)
    days = versions.read_by_tenant(spark, path, log).filter(F.col("day") >= dt.date(2024, 1, 10))
    return audit.for_tenant(days, "t0").groupBy("day", "decision").agg(F.count(F.lit(1)).alias("n"))
