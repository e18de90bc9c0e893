"""Streaming queries: the audit log replayed as files, run until the input is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.operators import risk as rk
from palisade.operators.audit import REQUEST_BUCKETS
from palisade.plans.mask_queries import CONTACT_RULES, KEY, fingerprint_sql
from palisade.plans.registry import CHECK_SQL, over_audit, over_contact, query
from palisade.plans import risk_queries
from palisade.plans.risk_queries import _BURSTS, _QPS, _SLOTS
from palisade.sources import tables as t
from palisade.streaming import ordered as o
from palisade.streaming import stateless as sl
from palisade.session import scratch_path
from palisade.streaming.runtime import arrivals, configure_state, follow, replay, replay_in_order, run_available, split_late

# The log with a per-tenant sequence; some numbers are lost on the way.
_SEQUENCED = "SELECT tenant_id, id, ts, event_uuid, decision, row_number() OVER (PARTITION BY tenant_id ORDER BY ts, id) AS seq, k FROM audit_log"
_ARRIVED = "seq % 50 <> 0 AND seq % 321 > 2"
SEQUENCED = f"sequenced AS ({_SEQUENCED})"


def _sequenced(spark, d):
    from palisade.functions.segments import row_numbers, time_slice

    log = t.audit_log(spark, d).select("tenant_id", "id", "ts", "event_uuid", "decision", "k")
    return row_numbers(log, ["tenant_id"], ["ts", "id"], time_slice("ts"), "seq")


def _with_flush(rows):
    """One far later event of another tenant lets the clock pass all waiting times."""
    last = rows.agg(F.max("ts").alias("ts"))
    flush = last.select(
        F.lit("~").alias("tenant_id"), F.lit(-1).cast("bigint").alias("id"), (F.col("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts"), F.lit(1_000_000).cast("bigint").alias("seq")
    )
    return rows.unionByName(flush)


_GAPS = f"""SELECT tenant_id, prev + 1 AS seq, seq - 1 AS gap_end FROM (SELECT *, coalesce(lag(seq) OVER (PARTITION BY tenant_id ORDER BY seq), 0) AS prev FROM sequenced WHERE {_ARRIVED}) WHERE seq > prev + 1"""


# Arrivals also lack whole blocks of 500 numbers, three of them in a row, and the block that holds the cursor's successor.
_HOLES = f"({_ARRIVED}) AND NOT (seq BETWEEN 1000 AND 2600)"


@query("audit_stream", over_audit(f"""
SELECT tenant_id, 'event' AS kind, seq, id, CAST(NULL AS BIGINT) AS gap_end FROM sequenced WHERE {_HOLES} AND seq > 100
UNION ALL SELECT tenant_id, 'gap', prev + 1, NULL, seq - 1 FROM (
 SELECT *, coalesce(lag(seq) OVER (PARTITION BY tenant_id ORDER BY seq), 100) AS prev FROM sequenced WHERE {_HOLES} AND seq > 100) WHERE seq > prev + 1""", SEQUENCED))
def audit_stream(spark, d):
    """Events after a cursor that lies in a gap, and every missing range, whole blocks included."""
    configure_state(spark)
    arrived = _sequenced(spark, d).filter(_HOLES).select("tenant_id", "id", "ts", "seq")
    out = run_available(o.audit_stream(replay(spark, _with_flush(arrived)), cursor=100, block=500), "audit-stream")
    return out.filter("tenant_id <> '~'").select("tenant_id", "kind", "seq", "id", "gap_end")


@query("sequence_gaps", over_audit(_GAPS, SEQUENCED))
def sequence_gaps(spark, d):
    return o.sequence_gaps(_sequenced(spark, d).filter(_ARRIVED), block=500)


@query("stream_page", over_audit("""
SELECT tenant_id, seq, id, false AS consistent FROM sequenced WHERE seq > 50 AND seq < 100""", SEQUENCED))
def stream_page(spark, d):
    """A page that a lost number cuts short before the committed tail."""
    log = _sequenced(spark, d)
    tail = log.groupBy("tenant_id").agg(F.max("seq").alias("seq"))
    return o.stream_after(log.filter("seq % 50 <> 0 OR seq = 50"), 50, latest=tail).select("tenant_id", "seq", "id", "consistent")


@query("dedupe_events", over_audit("SELECT tenant_id, count(*) AS n, count(DISTINCT event_uuid) AS uuids FROM audit_log GROUP BY 1"))
def dedupe_events(spark, d):
    """Every third event arrives twice."""
    configure_state(spark)
    log = t.audit_log(spark, d).select("id", "tenant_id", "ts", "event_uuid")
    out = run_available(sl.dedupe_events(replay(spark, log.unionByName(log.filter("id % 3 = 0")))), "dedupe")
    return out.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_uuid").alias("uuids"))


_CHANNELS = """SELECT CASE WHEN n_nationkey % 2 = 0 THEN 't0' ELSE 't1' END AS tenant_id, concat('ch-', CAST(n_nationkey AS STRING)) AS channel_id, n_nationkey % 5 <> 0 AS enabled,
 CASE WHEN n_nationkey % 3 = 0 THEN '' WHEN n_nationkey % 3 = 1 THEN 'deny,Warn ' ELSE 'approve' END AS wanted FROM nation"""
CHANNELS = f"channels AS ({_CHANNELS})"


def _channels(spark, d):
    flat = t.select_over(spark, _CHANNELS, "nation", t.load(spark, d, "nation"))
    return flat.withColumn("decisions", F.when(F.col("wanted") == "", F.array().cast("array<string>")).otherwise(F.split("wanted", ",")))


@query("route_alerts", over_audit("""
SELECT c.channel_id, a.decision, count(*) AS n FROM audit_log a JOIN channels c ON c.tenant_id = a.tenant_id AND c.enabled
 AND list_contains(list_transform(string_split(CASE WHEN wanted = '' THEN 'deny,error' ELSE wanted END, ','), lambda x: lower(trim(x))), a.decision)
WHERE k % 13 <> 0 GROUP BY 1, 2""", CHANNELS))
def route_alerts(spark, d):
    details = F.when(F.col("k") % 13 == 0, '{"audit_phase":"intent"}')
    log = t.audit_log(spark, d).withColumn("details_json", details).select("id", "tenant_id", "ts", "decision", "details_json")
    out = run_available(sl.route_alerts(replay(spark, log), _channels(spark, d)), "alerts")
    return out.groupBy("channel_id", "decision").agg(F.count(F.lit(1)).alias("n"))


_BUCKET_NAMES = {f"le_{str(b).replace('.', '_')}": b for b in REQUEST_BUCKETS}


@query("stream_metrics", over_audit("""
SELECT date_trunc('day', ts) AS window_start, tenant_id, decision, count(*) AS n, sum(latency_ms)::BIGINT AS latency_sum_ms, """
    + ", ".join(f"count(*) FILTER (latency_ms / 1000.0::DOUBLE <= {b}::DOUBLE) AS {name}" for name, b in _BUCKET_NAMES.items())
    + " FROM audit_log GROUP BY 1, 2, 3"))
def stream_metrics(spark, d):
    """All windows and buckets: one far later event of another tenant closes the last day."""
    log = t.audit_log(spark, d).select("tenant_id", "ts", "decision", "latency_ms")
    last = log.agg(F.max("ts").alias("ts")).select(
        F.lit("~").alias("tenant_id"), (F.col("ts") + F.expr("INTERVAL 3 DAYS")).alias("ts"), F.lit("allow").alias("decision"), F.lit(0).cast("int").alias("latency_ms")
    )
    flushed = log.unionByName(last.withColumn("latency_ms", F.col("latency_ms").cast(log.schema["latency_ms"].dataType)))
    out = run_available(sl.stream_metrics(replay(spark, flushed), "1 day"), "metrics").filter("tenant_id <> '~'")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "tenant_id", "decision", "n", "latency_sum_ms", *_BUCKET_NAMES)


@query("rate_limit_stream", CHECK_SQL["rate_limits"])
def rate_limit_stream(spark, d):
    configure_state(spark)
    bursts = t.from_audit(spark, d, _BURSTS)
    return run_available(o.rate_limit(replay_in_order(spark, bursts), _QPS, _SLOTS), "limits").select("id", "limit_reason")


_TRIES = "SELECT id, tenant_id, ts, concat(' User', CAST(k % 4 AS STRING)) AS user_name FROM audit_log"


@query("attempt_limits", over_audit("""
SELECT id, allowed FROM tries_done""", f"tries AS ({_TRIES})",
    "turns AS (SELECT id, tenant_id, lower(trim(user_name)) AS u, epoch_us(ts)::DOUBLE / 1e6 AS at_s, row_number() OVER (PARTITION BY tenant_id, lower(trim(user_name)) ORDER BY ts, id) AS n FROM tries)",
    """tries_done(tenant_id, u, id, n, started, used, allowed) AS (SELECT tenant_id, u, id, n, at_s, 1, true FROM turns WHERE n = 1
 UNION ALL SELECT tenant_id, u, id, n, CASE WHEN fresh THEN at_s ELSE started END, CASE WHEN fresh THEN 1 WHEN used < 3 THEN used + 1 ELSE used END, fresh OR used < 3
 FROM (SELECT t.*, d.started, d.used, t.at_s - d.started >= 7200 AS fresh FROM tries_done d JOIN turns t ON t.tenant_id = d.tenant_id AND t.u = d.u AND t.n = d.n + 1))""").replace("WITH audit_log", "WITH RECURSIVE audit_log", 1))
def attempt_limits(spark, d):
    return o.attempt_limits(t.from_audit(spark, d, _TRIES), "user_name", 3, 7200.0).select("id", "allowed")


@query("attempt_limit_stream", CHECK_SQL["attempt_limits"])
def attempt_limit_stream(spark, d):
    configure_state(spark)
    tries = t.from_audit(spark, d, _TRIES)
    return run_available(o.attempt_limit(replay_in_order(spark, tries), "user_name", 3, 7200.0), "attempts").select("id", "allowed")


_DELIVERY = """SELECT id, tenant_id, datasource_id AS channel_id, ts, CASE k % 5 WHEN 0 THEN 'claim' WHEN 1 THEN 'ack' WHEN 2 THEN 'fail' WHEN 3 THEN 'claim' ELSE CASE WHEN k % 4 = 0 THEN 'replay' WHEN k % 4 = 1 THEN 'release' ELSE 'ack' END END AS action,
 CAST(1 + k % 3 AS BIGINT) AS seq, CASE WHEN k % 3 = 0 THEN 'w0' ELSE 'w1' END AS token FROM audit_log"""


@query("delivery_states", over_audit("""
SELECT id, applied, last_seq, failures, dead AS dead_letter, retry_after AS retry_after_s FROM steps""", f"deliveries AS ({_DELIVERY})",
    "turns AS (SELECT *, epoch_us(ts)::DOUBLE / 1e6 AS at_s, row_number() OVER (PARTITION BY tenant_id, channel_id ORDER BY ts, id) AS n FROM deliveries)",
    """steps(tenant_id, channel_id, n, id, applied, last_seq, failures, dead, retry_after, lease_until, holder) AS (
 SELECT tenant_id, channel_id, 0::BIGINT, NULL::BIGINT, false, 0::BIGINT, 0::BIGINT, false, 0.0::DOUBLE, 0.0::DOUBLE, '' FROM turns GROUP BY 1, 2
 UNION ALL SELECT tenant_id, channel_id, n, id, ok, CASE WHEN ok AND action = 'ack' THEN seq ELSE last_seq END,
  CASE WHEN ok AND action IN ('ack', 'replay') THEN 0 WHEN ok AND action = 'fail' THEN failures + 1 ELSE failures END,
  CASE WHEN ok AND action = 'fail' THEN failures + 1 >= 3 WHEN ok AND action = 'replay' THEN false ELSE dead END,
  CASE WHEN ok AND action IN ('ack', 'replay') THEN 0.0 WHEN ok AND action = 'fail' THEN at_s + [10, 30, 60, 300, 900][least(failures, 4) + 1] ELSE retry_after END,
  CASE WHEN ok AND action = 'claim' THEN at_s + 7200 WHEN ok THEN 0.0 ELSE lease_until END, CASE WHEN ok AND action = 'claim' THEN token WHEN ok THEN '' ELSE holder END
 FROM (SELECT t.*, s.last_seq, s.failures, s.dead, s.retry_after, s.lease_until, s.holder, CASE t.action WHEN 'claim' THEN NOT s.dead AND s.retry_after <= t.at_s AND s.lease_until <= t.at_s
   WHEN 'ack' THEN s.lease_until > t.at_s AND t.token = s.holder AND t.seq = s.last_seq + 1 WHEN 'replay' THEN s.dead ELSE s.lease_until > t.at_s AND t.token = s.holder END AS ok
  FROM steps s JOIN turns t ON t.tenant_id = s.tenant_id AND t.channel_id = s.channel_id AND t.n = s.n + 1))""").replace("WITH audit_log", "WITH RECURSIVE audit_log", 1).replace("AS retry_after_s FROM steps", "AS retry_after_s FROM steps WHERE n > 0", 1))
def delivery_states(spark, d):
    return o.delivery_states(t.from_audit(spark, d, _DELIVERY), 3, 7200.0).drop("tenant_id", "channel_id")


@query("delivery_state_stream", CHECK_SQL["delivery_states"])
def delivery_state_stream(spark, d):
    configure_state(spark)
    rows = t.from_audit(spark, d, _DELIVERY)
    return run_available(o.delivery_state(replay_in_order(spark, rows), 3, 7200.0), "delivery").drop("tenant_id", "channel_id")


_RECENT = "SELECT tenant_id, seq, id FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY seq DESC) AS rk FROM sequenced) WHERE rk <= 200"


@query("recent_history", over_audit(_RECENT, SEQUENCED))
def recent_history(spark, d):
    return o.recent(_sequenced(spark, d).select("tenant_id", "seq", "id"))


@query("recent_stream", over_audit(_RECENT, SEQUENCED))
def recent_stream(spark, d):
    configure_state(spark)
    rows = _sequenced(spark, d).select("tenant_id", "seq", "id")
    return o.recent_of(run_available(o.recent_stream(replay(spark, rows)), "recent"))


@query("redact_stream", over_contact(f"""
SELECT c_custkey, substr(phone, 1, 3) || '****' || right(phone, 4) AS phone, {fingerprint_sql('email')} AS email, '***' AS card_no FROM contact"""))
def redact_stream(spark, d):
    out = run_available(sl.redact_stream(replay(spark, t.contact(spark, d)), CONTACT_RULES, KEY), "redacted")
    return out.select("c_custkey", "phone", "email", "card_no")


@query("redact_reported", CHECK_SQL["redaction_report"])
def redact_reported(spark, d):
    """The reports of four micro-batches, added up."""
    feed = arrivals(spark, [t.contact(spark, d).filter(F.col("c_custkey") % 4 == i) for i in range(4)])
    _, report = sl.redact_reported(feed, CONTACT_RULES, KEY)
    by = report.groupBy("column_name", "sensitive_type").agg(F.sum("masked_cells").alias("masked_cells"), F.sum("hash_fallbacks").alias("hash_fallbacks"), F.max("key_version").alias("key_version"))
    return by


@query("assess_stream", CHECK_SQL["risk_verdicts"])
def assess_stream(spark, d):
    """The verdicts of the whole log in time order, five micro-batches, with rate limits decided as requests come in."""
    configure_state(spark)
    signals = t.query_signals(spark, d).withColumn("latency_ms", F.col("latency_ms") * 60000)
    feed = replay_in_order(spark, signals, rows_per_batch=max(1, -(-signals.count() // 5)), files=4)
    out = sl.assess_stream(feed, t.agents(spark, d), t.policies(spark, d), risk_queries.metadata(spark), qps=_QPS, max_concurrent=_SLOTS)
    return out.select("id", "decision", "risk", "reason_rule", "failed_closed")


# Three arrivals: the newest days first, then the oldest, then those between; the last two are late.
_FRESH, _OLD = "ts >= TIMESTAMP '2024-01-15'", "ts < TIMESTAMP '2024-01-08'"


@query("late_events", over_audit(f"SELECT tenant_id, NOT ({_FRESH}) AS late, count(*) AS n, min(ts) AS since, max(ts) AS until FROM audit_log GROUP BY 1, 2"))
def late_events(spark, d):
    configure_state(spark)
    log = t.audit_log(spark, d).select("id", "tenant_id", "ts")
    parts = [log.filter(_FRESH.replace("TIMESTAMP", "TIMESTAMP_NTZ")), log.filter(_OLD.replace("TIMESTAMP", "TIMESTAMP_NTZ"))]
    parts.append(log.filter(f"NOT ({_FRESH}) AND NOT ({_OLD})".replace("TIMESTAMP", "TIMESTAMP_NTZ")))
    out = run_available(o.flag_late(arrivals(spark, parts), 600.0, salts=4), "late")
    stamp = F.col("ts").cast("timestamp_ntz")
    return out.groupBy("tenant_id", "late").agg(F.count(F.lit(1)).alias("n"), F.min(stamp).alias("since"), F.max(stamp).alias("until"))


@query("split_late", CHECK_SQL["late_events"])
def split_late_rows(spark, d):
    """On-time and late rows of the same three arrivals, split by the query's own watermark."""
    log = t.audit_log(spark, d).select("id", "tenant_id", "ts")
    conditions = (_FRESH, _OLD, f"NOT ({_FRESH}) AND NOT ({_OLD})")
    parts = [log.filter(c.replace("TIMESTAMP", "TIMESTAMP_NTZ")) for c in conditions]
    on_time, late = split_late(arrivals(spark, parts), "ts", "10 minutes")
    out = on_time.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True)))
    stamp = F.col("ts").cast("timestamp_ntz")
    return out.groupBy("tenant_id", "late").agg(F.count(F.lit(1)).alias("n"), F.min(stamp).alias("since"), F.max(stamp).alias("until"))


@query("attempts_on_time", CHECK_SQL["attempt_limits"].replace("AS n FROM tries)", f"AS n FROM tries WHERE {_FRESH})"))
def attempts_on_time(spark, d):
    """Attempt budgets of the on-time rows alone: the stream follows the split one and drops none of its rows."""
    configure_state(spark)
    tries = t.from_audit(spark, d, _TRIES)
    conditions = (_FRESH, _OLD, f"NOT ({_FRESH}) AND NOT ({_OLD})")
    folder = scratch_path(spark, "on-time")
    on_time, _ = split_late(arrivals(spark, [tries.filter(c.replace("TIMESTAMP", "TIMESTAMP_NTZ")) for c in conditions]), "ts", "10 minutes", folder)
    fed = follow(spark, f"{folder}/on_time", on_time)
    return run_available(o.attempt_limit(fed, "user_name", 3, 7200.0), "on-time-attempts").select("id", "allowed")


_SECOND_HALF = "ts >= TIMESTAMP_NTZ '2024-01-15'"


@query("rate_limit_resumed", CHECK_SQL["rate_limits"])
def rate_limit_resumed(spark, d):
    """The first half of the log in batch, the second as a stream that starts from the batch run's buckets."""
    configure_state(spark)
    bursts = t.from_audit(spark, d, _BURSTS)
    first, second = bursts.filter(f"NOT {_SECOND_HALF}"), bursts.filter(_SECOND_HALF)
    states = rk.rate_limit_states(first, _QPS, _SLOTS)
    live = run_available(o.rate_limit(replay_in_order(spark, second), _QPS, _SLOTS, states=states), "resumed")
    return rk.rate_limits(first, _QPS, _SLOTS).unionByName(live).select("id", "limit_reason")


@query("delivery_resumed", CHECK_SQL["delivery_states"])
def delivery_resumed(spark, d):
    """The same of delivery cursors."""
    configure_state(spark)
    rows = t.from_audit(spark, d, _DELIVERY)
    first, second = rows.filter(f"NOT {_SECOND_HALF}"), rows.filter(_SECOND_HALF)
    live = run_available(o.delivery_state(replay_in_order(spark, second), 3, 7200.0, states=o.delivery_cursors(first, 3, 7200.0)), "resumed")
    return o.delivery_states(first, 3, 7200.0).unionByName(live).drop("tenant_id", "channel_id")
