"""Audit-log analytics: filters, KPIs, trends, rankings, summaries, alerts and state checks.

All counts are one-pass conditional aggregates grouped by `by` (the tenant by default), so a
hot tenant is pre-aggregated map-side before anything is shuffled.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.functions.segments import join_same, previous, running, time_slice
from palisade.functions.text import utrim

# Decisions in report order.
DECISIONS = ("allow", "deny", "approve", "warn")
TENANT = ("tenant_id",)


@dataclass(frozen=True)
class AuditFilter:
    time_start: dt.datetime | None = None
    time_end: dt.datetime | None = None
    agent_id: str | None = None
    actor: str | None = None
    datasource_id: str | None = None
    session_id: str | None = None
    mcp_tool: str | None = None
    action: str | None = None
    error_code: str | None = None
    event_uuid: str | None = None
    grant_id: str | None = None
    decisions: Sequence[str] = field(default_factory=tuple)
    stmt_types: Sequence[str] = field(default_factory=tuple)
    risk_min: int | None = None
    risk_max: int | None = None
    keyword: str = ""
    object_like: str = ""
    rule_like: str = ""


def _contains(column: str, text: str) -> Column:
    return F.lower(F.col(column)).contains(text.lower())


def filter_audit(df: DataFrame, f: AuditFilter) -> DataFrame:
    """All given conditions AND-ed; both time bounds are inclusive, text matches ignore case."""
    conditions: list[Column] = []
    if f.time_start is not None:
        conditions.append(F.col("ts") >= F.lit(f.time_start).cast(df.schema["ts"].dataType))
    if f.time_end is not None:
        conditions.append(F.col("ts") <= F.lit(f.time_end).cast(df.schema["ts"].dataType))
    for name in ("agent_id", "datasource_id", "session_id", "mcp_tool", "action", "error_code", "event_uuid"):
        value = getattr(f, name)
        if value is not None:
            conditions.append(F.col(name) == value)
    if f.actor is not None:
        named = [F.col(c) == f.actor for c in ("actor_id", "agent_id") if c in df.columns]
        conditions.append(named[0] if len(named) == 1 else named[0] | named[1])
    if f.grant_id is not None:
        quoted = F.to_json(F.array(F.lit(f.grant_id)))
        encoded = F.substr(quoted, F.lit(2), F.length(quoted) - 2)
        hit = F.lit(False)
        for key in ("task_grant_id", "grant_id", "request_id"):
            hit = hit | F.col("details_json").contains(F.concat(F.lit(f'"{key}":'), encoded))
        conditions.append(hit)
    if f.decisions:
        conditions.append(F.col("decision").isin(*f.decisions))
    if f.stmt_types:
        conditions.append(F.col("stmt_type").isin(*f.stmt_types))
    if f.risk_min is not None:
        conditions.append(F.col("risk_level") >= f.risk_min)
    if f.risk_max is not None:
        conditions.append(F.col("risk_level") <= f.risk_max)
    if f.keyword:
        conditions.append(_contains("sql_raw", f.keyword) | _contains("sql_norm", f.keyword))
    if f.object_like:
        conditions.append(_contains("objects", f.object_like))
    if f.rule_like:
        conditions.append(_contains("rule_hits", f.rule_like))
    for condition in conditions:
        df = df.filter(condition)
    return df


def page(df: DataFrame, number: int, size: int) -> DataFrame:
    """Page `number` (from 1), newest first. Spark keeps only number*size rows per task."""
    return df.orderBy(F.desc("ts"), F.desc("id")).offset((number - 1) * size).limit(size)


def page_after(df: DataFrame, ts: dt.datetime, row_id: int, size: int) -> DataFrame:
    """The page after a known last row: a filter instead of an offset, for deep paging."""
    bound = F.lit(ts).cast(df.schema["ts"].dataType)
    older = (F.col("ts") < bound) | ((F.col("ts") == bound) & (F.col("id") < row_id))
    return df.filter(older).orderBy(F.desc("ts"), F.desc("id")).limit(size)


@dataclass(frozen=True)
class DayWindow:
    """`days` whole UTC days ending with the day of `now`, and the equally long span before."""

    days: int
    now: dt.datetime

    def __post_init__(self) -> None:
        if not 1 <= self.days <= 90:
            raise ValueError("days must be between 1 and 90")

    @property
    def start(self) -> dt.datetime:
        return dt.datetime.combine(self.now.date(), dt.time()) - dt.timedelta(days=self.days - 1)

    @property
    def end(self) -> dt.datetime:
        return dt.datetime.combine(self.now.date(), dt.time()) + dt.timedelta(days=1)

    @property
    def previous_start(self) -> dt.datetime:
        return self.start - dt.timedelta(days=self.days)


def _at(df: DataFrame, moment: dt.datetime) -> Column:
    return F.lit(moment).cast(df.schema["ts"].dataType)


def in_window(df: DataFrame, window: DayWindow) -> DataFrame:
    return df.filter((F.col("ts") >= _at(df, window.start)) & (F.col("ts") < _at(df, window.end)))


def percentage_change(previous_value: Column, current: Column) -> Column:
    change = (current - previous_value).cast("double") / F.nullif(previous_value, F.lit(0)).cast("double") * 100
    return change


def kpi(
    audit: DataFrame,
    approvals: DataFrame,
    agents: DataFrame,
    datasources: DataFrame,
    window: DayWindow,
    by: Sequence[str] = TENANT,
) -> DataFrame:
    """Totals against the preceding window plus open approvals and inventory counts, per tenant."""
    current = F.col("ts") >= _at(audit, window.start)
    denied = F.col("decision") == "deny"
    both = audit.filter((F.col("ts") >= _at(audit, window.previous_start)) & (F.col("ts") < _at(audit, window.end)))
    counts = both.groupBy(*by).agg(
        F.count_if(current).alias("total_requests"),
        F.count_if(current & denied).alias("blocked"),
        F.count_if(~current).alias("__previous_total"),
        F.count_if(~current & denied).alias("__previous_blocked"),
    )
    pending = approvals.groupBy(*by).agg(F.count_if(F.col("status") == "pending").alias("pending_approvals"))
    active = agents.groupBy(*by).agg(F.count_if(F.col("status") == "active").alias("active_agents"))
    sources = datasources.groupBy(*by).agg(F.count(F.lit(1)).alias("datasources_total"))
    # From all four sides: a tenant without traffic has its open approvals and agents all the same, and so has a null one.
    shown = ("total_requests", "blocked", "__previous_total", "__previous_blocked", "pending_approvals", "active_agents", "datasources_total")
    stacked = counts
    for side in (pending, active, sources):
        stacked = stacked.unionByName(side, allowMissingColumns=True)
    joined = stacked.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in shown])
    return joined.select(
        *by,
        "total_requests",
        "blocked",
        "pending_approvals",
        "active_agents",
        "datasources_total",
        percentage_change(F.col("__previous_total"), F.col("total_requests")).alias("total_requests_delta"),
        percentage_change(F.col("__previous_blocked"), F.col("blocked")).alias("blocked_delta"),
    )


def trend(audit: DataFrame, tenants: DataFrame, window: DayWindow) -> DataFrame:
    """Daily counts per decision with every day of the window present, zeros included."""
    counts = (
        in_window(audit, window)
        .groupBy("tenant_id", F.to_date("ts").alias("day"))
        .agg(
            F.count(F.lit(1)).alias("total"),
            *[F.count_if(F.col("decision") == d).alias(d) for d in ("deny", "warn", "approve", "allow")],
        )
    )
    last_day = (window.end - dt.timedelta(days=1)).date()
    days = F.sequence(F.lit(window.start.date()), F.lit(last_day))
    calendar = tenants.select("tenant_id").distinct().select("tenant_id", F.explode(days).alias("day"))
    joined = calendar.join(counts, ["tenant_id", "day"], "left")
    return joined.select(
        "tenant_id",
        F.date_format("day", "yyyy-MM-dd").alias("day"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "deny", "warn", "approve", "allow")],
    )


def decision_distribution(audit: DataFrame, tenants: DataFrame, window: DayWindow) -> DataFrame:
    """Four rows per tenant, zeros kept; other decisions are left out."""
    counts = in_window(audit, window).groupBy("tenant_id", "decision").agg(F.count(F.lit(1)).alias("n"))
    fixed = tenants.select("tenant_id").distinct().select(
        "tenant_id", F.explode(F.array(*[F.lit(d) for d in DECISIONS])).alias("decision")
    )
    return fixed.join(counts, ["tenant_id", "decision"], "left").select(
        "tenant_id", "decision", F.coalesce("n", F.lit(0)).alias("n")
    )


def top_counts(df: DataFrame, column: str | Column, k: int, by: Sequence[str] = (), name: str = "value") -> DataFrame:
    """The k most frequent values, count descending then value ascending; blanks are skipped."""
    value = F.col(column) if isinstance(column, str) else column
    counts = (
        df.select(*by, value.alias(name))
        .filter(F.col(name).isNotNull() & (utrim(name) != ""))
        .groupBy(*by, name)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    if not by:
        return counts.orderBy(F.desc("n"), name).limit(k)
    # The rank limit is applied per task before the shuffle, so only k rows per group move.
    ranked = counts.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), name)))
    return ranked.filter(F.col("__rank") <= k).drop("__rank")


_HITS = "array<struct<RuleID:string,Decision:string>>"


def risk_top(audit: DataFrame, window: DayWindow, k: int = 5, by: Sequence[str] = TENANT) -> DataFrame:
    """Most frequent rules among non-allow hits; text that is not a hit list is skipped."""
    hits = in_window(audit, window).filter(F.col("rule_hits").isNotNull()).select(
        *by, F.inline(F.from_json("rule_hits", _HITS))
    )
    kept = hits.filter(F.coalesce(F.col("Decision") != "allow", F.lit(True)))
    return top_counts(kept, "RuleID", k, by, "rule_id")


def rule_sketches(audit: DataFrame, by: Sequence[str] = TENANT, capacity: int = 1024) -> DataFrame:
    """A frequent-item sketch of the rules among non-allow hits, one for each group and day, to be kept and combined.

    A sketch holds up to three quarters of `capacity` rules with exact counts; with more of them a count is at most 3.5 / `capacity`
    of the day's hits off. It is some kilobytes whatever the number of hits.
    """
    hits = audit.filter(F.col("rule_hits").isNotNull()).select(*by, F.to_date("ts").alias("day"), F.inline(F.from_json("rule_hits", _HITS)))
    kept = hits.filter(F.coalesce(F.col("Decision") != "allow", F.lit(True)) & F.col("RuleID").isNotNull() & (utrim("RuleID") != ""))
    return kept.groupBy(*by, "day").agg(F.expr(f"approx_top_k_accumulate(RuleID, {capacity})").alias("sketch"), F.count(F.lit(1)).alias("hits"))


def top_of_sketches(sketches: DataFrame, k: int = 5, by: Sequence[str] = TENANT, capacity: int = 1024) -> DataFrame:
    """Most frequent rules of any set of days, from their sketches alone: count descending, then the rule."""
    merged = sketches.groupBy(*by).agg(F.expr(f"approx_top_k_combine(sketch, {capacity})").alias("sketch"))
    # All that a sketch holds, so that ties are cut by name as in the exact form.
    counts = merged.select(*by, F.inline(F.expr(f"approx_top_k_estimate(sketch, {capacity})")).alias("rule_id", "n"))
    ranked = counts.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "rule_id")))
    return ranked.filter(F.col("__rank") <= k).drop("__rank")


def agent_ranking(audit: DataFrame, agents: DataFrame, window: DayWindow, k: int = 5) -> DataFrame:
    """Most blocked agents with their names, '' where the agent is unknown."""
    denied = in_window(audit, window).filter(F.col("decision") == "deny")
    top = top_counts(denied, "agent_id", k, TENANT, "agent_id").withColumnRenamed("n", "blocked_count")
    names = agents.select("tenant_id", "agent_id", "name")
    return top.join(names, ["tenant_id", "agent_id"], "left").withColumn("name", F.coalesce("name", F.lit("")))


def blocked_savings(audit: DataFrame, tenants: DataFrame, window: DayWindow, by: Sequence[str] = TENANT) -> DataFrame:
    """Denied requests and the rows they would have read, zeros for a tenant without any."""
    denied = F.col("decision") == "deny"
    counts = in_window(audit, window).filter(denied).groupBy(*by).agg(
        F.count(F.lit(1)).alias("blocked_count"), F.sum(F.coalesce("est_rows", F.lit(0))).alias("est_rows_saved")
    )
    return tenants.select(*by).distinct().join(counts, list(by), "left").select(
        *by, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("blocked_count", "est_rows_saved")]
    )


def with_status(df: DataFrame) -> DataFrame:
    return df.withColumn("status", F.when(F.col("decision") == "error", "error").otherwise("success"))


def _labelled(column: str, fallback: str, df: DataFrame) -> Column:
    if column not in df.columns:
        return F.lit(fallback)
    return F.when(F.coalesce(utrim(column), F.lit("")) == "", fallback).otherwise(F.col(column))


def report_summary(df: DataFrame) -> DataFrame:
    """Report lines: total, time range, and the action and status distributions, from one scan.

    Grouping sets give the distributions together; each line is (section, key, n, since, until).
    """
    base = with_status(df).select("ts", "status", _labelled("action", "<none>", df).alias("action"))
    sets = base.groupingSets([[], ["action"], ["status"]], "action", "status").agg(
        F.grouping_id().alias("__set"), F.count(F.lit(1)).alias("n"), F.min("ts").alias("since"), F.max("ts").alias("until")
    )
    section = F.when(F.col("__set") == 3, "total").when(F.col("__set") == 1, "action").otherwise("status")
    return sets.select(section.alias("section"), F.coalesce("action", "status", F.lit("")).alias("key"), "n", "since", "until")


def summary_lines(report: DataFrame) -> DataFrame:
    """The `key=n` text form of the distribution lines."""
    return report.filter(F.col("section") != "total").select(
        "section", F.concat(F.col("key"), F.lit("="), F.col("n").cast("string")).alias("line")
    )


def actor(df: DataFrame) -> Column:
    """The acting identity: actor_id, else agent_id, else <unknown>."""
    known = [F.nullif(utrim(c), F.lit("")) for c in ("actor_id", "agent_id") if c in df.columns]
    shown = [F.when(k.isNotNull(), F.col(c)) for k, c in zip(known, [c for c in ("actor_id", "agent_id") if c in df.columns])]
    return F.coalesce(*shown, F.lit("<unknown>"))


# Message fragments per error category, first match wins.
ERROR_FRAGMENTS = (
    ("rate_limited", ("rate limit", "too many requests", "qps", "status 429")),
    ("row_limit", ("row limit", "too many rows", "result too large", "rows exceeded")),
    ("timeout", ("timeout", "timed out", "deadline exceeded", "context deadline")),
    ("permission_denied", (
        "permission denied", "access denied", "unauthorized", "forbidden", "authentication failed", "not authorized")),
    ("syntax", ("syntax error", "parse error", "invalid syntax")),
    ("connect_error", (
        "connection refused", "connect error", "dial tcp", "dial udp", "no such host", "network is unreachable",
        "connection reset")),
)
# Error codes that are passed on as they are.
STABLE_ERROR_CODES = (
    "DB_OBJECT_NOT_FOUND", "DB_COLUMN_NOT_FOUND", "DB_OBJECT_ALREADY_EXISTS", "DB_SYNTAX_ERROR",
    "DB_SEMANTIC_ERROR", "DB_DATA_EXCEPTION", "DB_CONSTRAINT_VIOLATION", "DB_RETRYABLE_CONFLICT",
    "DB_TRANSACTION_STATE", "DB_RESOURCE_EXHAUSTED", "DB_QUERY_TIMEOUT", "DB_QUERY_INTERRUPTED",
    "DB_PERMISSION_DENIED", "DB_READ_ONLY_VIOLATION", "DB_AUTHENTICATION_FAILED", "DB_DATABASE_NOT_FOUND",
    "DB_DATASOURCE_UNREACHABLE", "DB_EXECUTION_FAILED", "GATEWAY_INTERNAL", "AUDIT_UNAVAILABLE",
    "AUDIT_OVERLOADED", "COMMIT_OUTCOME_UNKNOWN",
)


def message_category(message: Column) -> Column:
    lowered = F.lower(F.coalesce(message, F.lit("")))
    chosen = F.lit("unknown")
    for category, fragments in reversed(ERROR_FRAGMENTS):
        hit = lowered.contains(fragments[0])
        for fragment in fragments[1:]:
            hit = hit | lowered.contains(fragment)
        chosen = F.when(hit, category).otherwise(chosen)
    return chosen


def error_category(code: Column, message: Column, decision: Column) -> Column:
    """A stored code if it is a known one, else a category read from the message; NULL without error."""
    stored = F.nullif(utrim(code), F.lit(""))
    has_error = (F.coalesce(utrim(message), F.lit("")) != "") | (F.lower(utrim(decision)) == "error")
    return F.when(
        stored.isNotNull(), F.when(stored.isin(*STABLE_ERROR_CODES), stored).otherwise("unknown")
    ).when(has_error, message_category(message))


def rule_ids(hits_json: Column) -> Column:
    """Distinct rule ids of a hit list in first-seen order, accepting four spellings of the key."""
    parsed = F.from_json(hits_json, "array<map<string,string>>")
    ids = F.transform(
        parsed,
        lambda hit: F.coalesce(*[F.nullif(utrim(hit.getItem(k)), F.lit("")) for k in ("rule_id", "RuleID", "id", "ID")]),
    )
    return F.coalesce(F.array_distinct(F.array_compact(ids)), F.array().cast("array<string>"))


def is_intent(details: Column) -> Column:
    return F.coalesce(F.get_json_object(details, "$.audit_phase") == "intent", F.lit(False))


def alert_payload(
    df: DataFrame, agents: DataFrame, datasources: DataFrame, include_sql: bool = False
) -> DataFrame:
    """The outbound whitelist of an audit row with display names joined in."""
    def column(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast(kind)

    stamped = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    named_agents = agents.select("tenant_id", "agent_id", F.trim("name").alias("agent_name"))
    named_sources = datasources.select("tenant_id", "datasource_id", F.trim("name").alias("datasource_name"))
    joined = df.join(named_agents, ["tenant_id", "agent_id"], "left").join(
        named_sources, ["tenant_id", "datasource_id"], "left"
    )
    payload = joined.select(
        "tenant_id",
        F.col("id").alias("audit_id"),
        stamped.alias("timestamp"),
        F.lower(utrim("decision")).alias("decision"),
        F.array_join(rule_ids(column("rule_hits")), ",").alias("rule_ids"),
        "datasource_id",
        "datasource_name",
        "agent_id",
        "agent_name",
        "stmt_type",
        "est_rows",
        "latency_ms",
        error_category(column("error_code"), column("error_msg"), F.col("decision")).alias("error_code"),
        *([column("sql_norm").alias("sql_norm")] if include_sql else []),
    )
    return payload


# Key parts and address schemes that make event details unsafe to keep.
UNSAFE_KEY = (
    r"(?i)(^|_)(key_b64|key_file|password|passwd|secret|token|dsn|sample|samples|sample_value|sample_values"
    r"|raw_value|raw_values|preview)($|_)"
)
UNSAFE_ADDRESS = r"(?i)postgres(?:ql)?://|mysql://"


def unsafe_details(details: Column) -> Column:
    """True for a secret-like key at any depth, an address with credentials, or text that is not JSON.

    Whole string tokens are consumed left to right; one followed by ':' is an object key.
    """
    tokens = F.regexp_extract_all(details, F.lit(r'"(?:[^"\\]|\\.)*"\s*:?'), F.lit(0))
    keys = F.filter(tokens, lambda t: t.endswith(":"))
    plain = F.transform(keys, lambda t: F.regexp_replace(t, r'^"|"\s*:$', ""))
    decoded = F.transform(
        plain,
        lambda k: F.when(
            k.contains("\\"), F.get(F.from_json(F.concat(F.lit('["'), k, F.lit('"]')), "array<string>"), F.lit(0))
        ).otherwise(k),
    )
    key_hit = F.exists(decoded, lambda k: k.rlike(UNSAFE_KEY))
    valid = F.try_parse_json(details).isNotNull()
    return F.coalesce(details.rlike(UNSAFE_ADDRESS) | ~valid | key_hit, F.lit(True))


def outbox_stats(outbox: DataFrame, now: dt.datetime, by: Sequence[str] = TENANT) -> DataFrame:
    """Backlog of undelivered events and the alarm level of its oldest entry."""
    age = F.lit(now).cast("timestamp").cast("bigint") - F.min(F.col("created_at").cast("timestamp")).cast("bigint")
    stats = outbox.filter(F.col("delivered_at").isNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("pending"),
        F.count_if(F.col("attempts") > 0).alias("retrying"),
        age.alias("oldest_age_s"),
    )
    level = F.when(F.col("oldest_age_s") > 1800, "critical").when(F.col("oldest_age_s") > 300, "warn").otherwise("ok")
    return stats.withColumn("level", level)


def approvals_page(approvals: DataFrame, status: str | None, size: int) -> DataFrame:
    kept = approvals if status is None else approvals.filter(F.col("status") == status)
    return kept.orderBy(F.desc("created_at"), F.desc("id")).limit(size)


def counters(df: DataFrame) -> DataFrame:
    """Counter families in one shape: requests by decision, dialect and statement; rules by decision."""
    requests = df.groupBy("decision", "datasource_id", "stmt_type").agg(F.count(F.lit(1)).alias("n"))
    hits = df.select(F.inline(F.from_json("rule_hits", _HITS))).groupBy("RuleID", "Decision").agg(
        F.count(F.lit(1)).alias("n")
    )
    return requests.select(
        F.lit("requests").alias("family"),
        F.concat_ws("|", "decision", "datasource_id", "stmt_type").alias("labels"),
        "n",
    ).unionByName(
        hits.select(F.lit("rule_hits").alias("family"), F.concat_ws("|", "RuleID", "Decision").alias("labels"), "n")
    )


# Histogram bounds in seconds for whole requests and for single stages.
REQUEST_BUCKETS = (0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)
STAGE_BUCKETS = (0.0005, 0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0)


def latency_histogram(df: DataFrame, seconds: Column, by: Sequence[str], bounds: Sequence[float] = REQUEST_BUCKETS) -> DataFrame:
    """Cumulative bucket counts, one row per group and bound, +Inf and the sum included."""
    # The groups are few, so the wide aggregate is unpivoted only after it has been reduced.
    wide = df.withColumn("__s", seconds).groupBy(*by).agg(
        *[F.count_if(F.col("__s") <= bound).alias(f"__b{i}") for i, bound in enumerate(bounds)],
        F.count("__s").alias("__n"),
        F.sum("__s").alias("latency_sum"),
    )
    rows = F.array(
        *[F.struct(F.lit(str(b)).alias("le"), F.col(f"__b{i}").alias("n")) for i, b in enumerate(bounds)],
        F.struct(F.lit("+Inf").alias("le"), F.col("__n").alias("n")),
    )
    return wide.select(*by, F.inline(rows), "latency_sum")


def latency_percentiles(df: DataFrame, column: str, by: Sequence[str], slice_width: int = 1000, exact: bool = True) -> DataFrame:
    """P50, P95, P99, P99.9 per group: the smallest value whose cumulative share reaches the point.

    Exact from counted distinct values and sliced running counts, so neither a busy group nor a
    wide value range ends in one buffer. `exact=False` is a bounded sketch.
    """
    points = {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p999": 0.999}
    if not exact:
        sketch = df.groupBy(*by).agg(F.percentile_approx(column, list(points.values()), 10000).alias("__p"))
        return sketch.select(*by, *[F.get("__p", F.lit(i)).alias(n) for i, n in enumerate(points)])
    counted = df.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("__c"))
    totals = counted.groupBy(*by).agg(F.sum("__c").alias("__n"))
    upto = join_same(running(counted, by, [column], F.floor(F.col(column) / slice_width), F.col("__c"), "__upto"), totals, list(by))
    reached = lambda p: F.col("__upto") >= F.ceil(F.col("__n") * p)
    return upto.groupBy(*by).agg(*[F.min(F.when(reached(p), F.col(column))).alias(n) for n, p in points.items()])


def check_distribution(actual: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows where the counted and the expected number differ, missing sides counted as 0."""
    counted = actual.groupBy(*keys).agg(F.count(F.lit(1)).alias("actual"))
    joined = counted.join(expected, list(keys), "full_outer").select(
        *keys, F.coalesce("actual", F.lit(0)).alias("actual"), F.coalesce("expected", F.lit(0)).alias("expected")
    )
    return joined.filter(F.col("actual") != F.col("expected"))


def synthetic_audit(spark: SparkSession, days: int, per_day: int, anchor: dt.date) -> DataFrame:
    """A deterministic audit history for load trials: every field follows from the row number."""
    ordinal = F.col("id")
    slot = ((ordinal - 1) % 300).cast("int")
    decision = F.when(slot < 180, "allow").when(slot < 240, "deny").when(slot < 276, "warn").otherwise("approve")
    day = F.date_add(F.lit(anchor), (F.floor((ordinal - 1) / per_day) - (days - 1)).cast("int"))
    return spark.range(1, days * per_day + 1).select(
        "id",
        F.lit("default").alias("tenant_id"),
        F.timestamp_seconds(F.unix_date(day) * 86400 + (ordinal * 7919) % 86400).alias("ts"),
        F.concat(F.lit("agent-"), (ordinal % 5).cast("string")).alias("agent_id"),
        F.when(ordinal % 2 == 0, "mysql").otherwise("postgres").alias("db_type"),
        decision.alias("decision"),
        F.concat(F.lit("SELECT id FROM customers WHERE id = "), ordinal.cast("string")).alias("sql_raw"),
        (8 + (ordinal * 17) % 193).alias("latency_ms"),
    )


def verification_lag(df: DataFrame, now: dt.datetime, interval_s: int) -> DataFrame:
    """Alarm where the last verification is later than 120 % of the interval."""
    age = F.lit(now).cast("timestamp").cast("bigint") - F.col("last_verified").cast("timestamp").cast("bigint")
    return df.withColumn("age_s", age).withColumn("lagging", F.coalesce(age * 100 > interval_s * 120, F.lit(True)))


_LITERALS = r"'(?:[^']|'')*'|\b[0-9]+(?:\.[0-9]+)?\b"


def normalized_sql(sql: Column) -> Column:
    """Statement text with its string and number literals replaced by '?', blanks squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(sql, _LITERALS, "?"), r"\s+", " "))


def query_shapes(df: DataFrame, sql_column: str = "sql_raw", norm_column: str | None = None) -> DataFrame:
    shape = normalized_sql(F.col(sql_column))
    if norm_column is not None:
        shape = F.coalesce(F.nullif(F.trim(norm_column), F.lit("")), shape)
    return df.groupBy(shape.alias("sql_shape")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        F.countDistinct("agent_id").alias("agents"),
    )


def invalid_transitions(
    events: DataFrame, edges: DataFrame, keys: Sequence[str], order: Sequence[str], state: str, slice_unit: str = "hour"
) -> DataFrame:
    """Consecutive states that are neither equal nor a listed (from_state, to_state) edge.

    `edges` may carry a status column; then a step must also arrive in that status.
    """
    stepped = previous(events, keys, order, time_slice(order[0], slice_unit), [state]).filter(
        F.col(f"prev_{state}").isNotNull() & (F.col(f"prev_{state}") != F.col(state))
    )
    match = [
        F.col("s." + f"prev_{state}") == F.col("e.from_state"),
        F.col("s." + state) == F.col("e.to_state"),
    ]
    if "to_status" in edges.columns:
        match.append(F.col("s.status") == F.col("e.to_status"))
    return stepped.alias("s").join(edges.alias("e"), match, "left_anti")


def expired(df: DataFrame, deadlines: Sequence[str], now: dt.datetime, limit: int, status: str = "status") -> DataFrame:
    """Open sessions or transactions with any deadline passed, oldest first (a bounded work list)."""
    moment = F.lit(now)
    late = F.lit(False)
    for name in deadlines:
        late = late | F.coalesce(F.col(name) <= moment.cast(df.schema[name].dataType), F.lit(False))
    return df.filter((F.col(status) != "TERMINAL") & late).orderBy(deadlines[0], "id").limit(limit)


def state_counts(df: DataFrame, by: Sequence[str] = TENANT, status: str = "status") -> DataFrame:
    return df.groupBy(*by, status).agg(F.count(F.lit(1)).alias("n"))


def for_tenant(df: DataFrame, tenant_id: str) -> DataFrame:
    """Only one tenant's rows; asking without a tenant is an error, never "all tenants"."""
    if not tenant_id or not tenant_id.strip():
        raise ValueError("a tenant id is required")
    return df.filter(F.col("tenant_id") == tenant_id)
