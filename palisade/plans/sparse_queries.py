"""The order-dependent operators over a log with null tenants, users, sessions and times: no row may get lost."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from palisade.operators import audit
from palisade.operators import chain as c
from palisade.operators import policy as p
from palisade.operators import risk as rk
from palisade.operators import series as s
from palisade.plans.audit_queries import AGENTS, WINDOW, _BOTH
from palisade.plans.integrity_queries import CONFIG
from palisade.plans.registry import CHECK_SQL, query, with_ctes
from palisade.plans.risk_queries import _QPS, _SLOTS
from palisade.plans.stream_queries import _DELIVERY
from palisade.sources import tables as t
from palisade.streaming import ordered as o

# Every seventh row has no tenant, every fifth no agent, every ninth no session, every eleventh no time.
_HOLES = {"tenant_id": 7, "agent_id": 5, "session_id": 9, "ts": 11}
SPARSE = (
    "SELECT * REPLACE (" + ", ".join(f"CASE WHEN id % {n} <> 0 THEN {name} END AS {name}" for name, n in _HOLES.items()) + f") FROM ({t.AUDIT_LOG_SQL})"
)


def sparse(spark, d):
    log = t.audit_log(spark, d)
    return log.withColumns({name: F.when(F.col("id") % n != 0, F.col(name)) for name, n in _HOLES.items()})


def over_sparse(body: str, *ctes: str) -> str:
    return with_ctes(body, f"audit_log AS ({SPARSE})", *ctes)


def _again(name: str, changes: dict[str, str]) -> str:
    """The check SQL of another query over the sparse log."""
    text = CHECK_SQL[name].replace(f"audit_log AS ({t.AUDIT_LOG_SQL})", f"audit_log AS ({SPARSE})", 1)
    for old, new in changes.items():
        if old not in text:
            raise ValueError(f"{name}: {old}")
        text = text.replace(old, new)
    return text


@query("sparse_percentiles", over_sparse("""
SELECT tenant_id, percentile_disc(0.5) WITHIN GROUP (ORDER BY latency_ms) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms) AS p95,
 percentile_disc(0.99) WITHIN GROUP (ORDER BY latency_ms) AS p99, percentile_disc(0.999) WITHIN GROUP (ORDER BY latency_ms) AS p999 FROM audit_log GROUP BY 1"""))
def sparse_percentiles(spark, d):
    return audit.latency_percentiles(sparse(spark, d), "latency_ms", ["tenant_id"])


@query("sparse_kpi", over_sparse(f"""
SELECT tenant_id, sum(a)::BIGINT AS total_requests, sum(b)::BIGINT AS blocked, sum(c)::BIGINT AS pending_approvals, sum(d)::BIGINT AS active_agents, sum(e)::BIGINT AS datasources_total FROM (
 SELECT tenant_id, (ts >= TIMESTAMP '2024-01-17')::BIGINT AS a, (ts >= TIMESTAMP '2024-01-17' AND decision = 'deny')::BIGINT AS b, 0 AS c, 0 AS d, 0 AS e FROM audit_log WHERE {_BOTH}
 UNION ALL SELECT tenant_id, 0, 0, (k % 4 = 0)::BIGINT, 0, 0 FROM audit_log WHERE decision = 'approve'
 UNION ALL SELECT CASE WHEN agent_id <> 'agent-3' THEN tenant_id END, 0, 0, 0, (status = 'active')::BIGINT, 0 FROM agents
 UNION ALL SELECT NULL, 0, 0, 0, 0, 1 UNION ALL SELECT 't0', 0, 0, 0, 0, 1) GROUP BY 1""", AGENTS))
def sparse_kpi(spark, d):
    log = sparse(spark, d)
    pending = F.when(F.col("k") % 4 == 0, "pending").otherwise("approved")
    approvals = log.filter("decision = 'approve'").select("tenant_id", pending.alias("status"))
    agents = t.agents(spark, d).withColumn("tenant_id", F.when(F.col("agent_id") != "agent-3", F.col("tenant_id")))
    sources = spark.createDataFrame([(None, "ds-0"), ("t0", "ds-1")], "tenant_id string, datasource_id string")
    out = audit.kpi(log, approvals, agents, sources, WINDOW)
    return out.select("tenant_id", "total_requests", "blocked", "pending_approvals", "active_agents", "datasources_total")


@query("sparse_transitions", over_sparse("""
SELECT session_id, id, stmt_type, prev AS prev_stmt_type FROM (
 SELECT *, lag(stmt_type) OVER (PARTITION BY session_id ORDER BY ts NULLS FIRST, id) AS prev FROM audit_log)
WHERE prev IS NOT NULL AND prev <> stmt_type AND (prev, stmt_type) NOT IN (('SELECT','INSERT'), ('INSERT','SELECT'))"""))
def sparse_transitions(spark, d):
    edges = spark.createDataFrame([("SELECT", "INSERT"), ("INSERT", "SELECT")], "from_state string, to_state string")
    out = audit.invalid_transitions(sparse(spark, d), edges, ["session_id"], ["ts", "id"], "stmt_type")
    return out.select("session_id", "id", "stmt_type", "prev_stmt_type")


@query("sparse_grant_usage", over_sparse("""
SELECT id, session_id AS grant_id, row_number() OVER (PARTITION BY session_id ORDER BY ts NULLS FIRST, id) AS use_no,
 session_id IS NOT NULL AND row_number() OVER (PARTITION BY session_id ORDER BY ts NULLS FIRST, id) <= 3 AS granted FROM audit_log"""))
def sparse_grant_usage(spark, d):
    log = sparse(spark, d).select("id", "ts", F.col("session_id").alias("grant_id"))
    grants = log.select("grant_id").distinct().filter("grant_id IS NOT NULL").withColumn("max_uses", F.lit(3))
    return p.grant_usage(log, grants).select("id", "grant_id", "use_no", "granted")


@query("sparse_gaps", over_sparse("""
SELECT tenant_id, prev + 1 AS seq, id - 1 AS gap_end FROM (SELECT *, coalesce(lag(id) OVER (PARTITION BY tenant_id ORDER BY id), 0) AS prev FROM audit_log WHERE id > 0) WHERE id > prev + 1"""))
def sparse_gaps(spark, d):
    return o.sequence_gaps(sparse(spark, d).select("tenant_id", F.col("id").alias("seq")), block=500)


@query("sparse_forecast", over_sparse("""
SELECT agent_id, n AS input_rows, i::INT AS ahead, (xl + i * step)::VARCHAR AS label, round(ym + slope * (xl + i * step - xm), 2) AS value
FROM (SELECT f.*, (SELECT list_sort(list(gap)) FROM (SELECT x - lag(x) OVER (ORDER BY x) AS gap FROM marks m WHERE m.agent_id IS NOT DISTINCT FROM f.agent_id) WHERE gap IS NOT NULL)[(f.n - 1) // 2 + 1] AS step
 FROM (SELECT agent_id, count(*) AS n, regr_slope(rows, x) AS slope, avg(x) AS xm, avg(rows) AS ym, max(x) AS xl FROM marks GROUP BY 1 HAVING count(*) >= 3) f), (SELECT unnest([1, 2, 3]) AS i)""",
    "marks AS (SELECT agent_id, k + 100000 AS x, count(*) AS rows FROM audit_log GROUP BY 1, 2)"))
def sparse_forecast(spark, d):
    counts = sparse(spark, d).groupBy("agent_id", (F.col("k") + 100_000).alias("x")).agg(F.count(F.lit(1)).alias("rows"))
    return s.forecast(counts, ["agent_id"], "x", "rows", "x", slice_col=F.floor(F.col("x") / 10))


@query("sparse_chain", over_sparse("""
SELECT tenant_id, agent_id AS chain_id, 'VALID_AT_OBSERVED_HEAD' AS outcome, count(*) AS total_rows, 0::BIGINT AS unchained, 0 AS code FROM audit_log GROUP BY 1, 2"""))
def sparse_chain(spark, d):
    log = sparse(spark, d).withColumns({"ts": F.coalesce("ts", F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz")), "chain_id": F.col("agent_id")})
    chained = log.join(c.build_chain(log, CONFIG, max_block_rows=200).drop("tenant_id", "chain_id"), "id")
    return c.verify_chain(chained, c.chain_state(chained, CONFIG), CONFIG, seq_block=100).drop("break_seq", "break_id")


@query("sparse_rate_limits", _again("rate_limits", {
    "AS n FROM bursts)": "AS n FROM bursts WHERE ts IS NOT NULL)",
    "t.tenant_id = b.tenant_id AND t.agent_id = b.agent_id": "t.tenant_id IS NOT DISTINCT FROM b.tenant_id AND t.agent_id IS NOT DISTINCT FROM b.agent_id",
    "SELECT id, reason AS limit_reason FROM bucket": "SELECT id, reason AS limit_reason FROM bucket UNION ALL SELECT id, 'no_time' FROM bursts WHERE ts IS NULL",
}))
def sparse_rate_limits(spark, d):
    """In several blocks, each handing its buckets on to the next."""
    bursts = sparse(spark, d).withColumn("latency_ms", F.col("latency_ms") * 60000)
    return rk.rate_limits(bursts, _QPS, _SLOTS, max_block_rows=150).select("id", "limit_reason")


@query("sparse_attempts", _again("attempt_limits", {
    "AS n FROM tries)": "AS n FROM tries WHERE ts IS NOT NULL AND tenant_id IS NOT NULL)",
    "SELECT id, allowed FROM tries_done": "SELECT id, allowed FROM tries_done UNION ALL SELECT id, false FROM tries WHERE ts IS NULL AND tenant_id IS NOT NULL",
}))
def sparse_attempts(spark, d):
    """Attempts without a tenant belong to no budget, like those with an empty one; attempts without a time are refused."""
    tries = sparse(spark, d).withColumn("user_name", F.concat(F.lit(" User"), (F.col("k") % 4).cast("string")))
    return o.attempt_limits(tries, "user_name", 3, 7200.0, max_block_rows=150).select("id", "allowed")


@query("sparse_deliveries", _again("delivery_states", {
    "AS n FROM deliveries)": "AS n FROM deliveries WHERE ts IS NOT NULL)",
    "t.tenant_id = s.tenant_id AND t.channel_id = s.channel_id": "t.tenant_id IS NOT DISTINCT FROM s.tenant_id AND t.channel_id = s.channel_id",
    "AS retry_after_s FROM steps WHERE n > 0": "AS retry_after_s FROM steps WHERE n > 0 UNION ALL SELECT id, false, 0, 0, false, 0.0 FROM deliveries WHERE ts IS NULL",
}))
def sparse_deliveries(spark, d):
    rows = t.select_over(spark, _DELIVERY, "audit_log", sparse(spark, d))
    return o.delivery_states(rows, 3, 7200.0, max_block_rows=150).drop("tenant_id", "channel_id")
