"""Risk rules over a log of statement signals, and the verdict they add up to.

Every rule is one column; all of them are evaluated in a single projection. Facts that live
in other tables (agent level, table metadata, policy, rate limits, configuration) are joined
in first by id.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.functions.folds import MAX_BLOCK_ROWS, ordered_fold, ordered_states
from palisade.functions.segments import time_slice
from palisade.operators import policy
from palisade.session import spread

# Known dialects and statement kinds, rule order, and default thresholds.
DIALECTS = ("postgres", "mysql", "sqlserver", "dm", "oracle", "vastbase", "highgo", "opengauss", "yashan")
STATEMENTS = ("SELECT", "INSERT", "UPDATE", "DELETE", "DDL", "ADMIN", "UNKNOWN")
RULE_LEVELS = {
    "R001": "deny", "R002": "deny", "R003": "deny", "R004": "approve", "R005": "warn", "R006": "deny", "R007": "deny",
    "R008": "deny", "R009": "approve", "R010": "deny", "R101": "deny", "R102": "approve", "R103": "deny", "R104": "deny",
    "R105": "approve", "R106": "approve", "R107": "warn", "R201": "deny", "R202": "approve", "R203": "deny", "R204": "approve",
}
DEFAULTS = {
    "max_scan_rows": 100_000, "row_limit": 1_000, "qps_per_agent": 20, "max_conns_per_datasource": 5, "max_sql_length": 1 << 20,
    "max_nesting_depth": 16, "max_union_count": 16, "large_table_rows": 100_000, "long_transaction_ms": 5_000,
    "idle_transaction_ms": 5_000, "mysql_transaction_age_ms": 5_000, "mysql_transaction_affected_rows": 100_000,
}
PRIORITY = {"deny": 3, "approve": 2, "warn": 1, "allow": 0}
RISK = {"deny": 1, "approve": 2, "warn": 3, "allow": 4}
# Functions and operations the rules look for.
DANGEROUS_FUNCTIONS = {
    "postgres": ("pg_sleep",),
    "mysql": ("benchmark", "sleep"),
    "sqlserver": ("xp_cmdshell", "sp_oacreate", "openrowset", "opendatasource", "waitfor"),
}
ADMIN_FUNCTIONS = (
    "lo_export", "lo_import", "pg_cancel_backend", "pg_ls_dir", "pg_ls_logdir", "pg_read_binary_file", "pg_read_file",
    "pg_reload_conf", "pg_rotate_logfile", "pg_stat_file", "pg_terminate_backend",
)
DROP_OPERATIONS = tuple(
    f"DROP {kind}" for kind in (
        "DATABASE", "TABLE", "SCHEMA", "SEQUENCE", "FUNCTION", "PROCEDURE", "VIEW", "MATERIALIZED VIEW")
)
LOCKING_OPERATIONS = ("VACUUM FULL", "REINDEX", "CLUSTER")
FILE_OPERATIONS = ("LOAD_FILE", "INTO OUTFILE", "INTO DUMPFILE")
SERVER_OPERATIONS = ("FLUSH", "KILL", "PURGE", "SET GLOBAL")


def _stmt(*kinds: str) -> Column:
    return F.upper("stmt_type").isin(*kinds)


def _operations() -> Column:
    def clean(o: Column) -> Column:
        spaced = o.contains("  ") | o.contains("\t") | o.contains("\n")
        return F.upper(F.trim(F.when(spaced, F.regexp_replace(o, r"\s+", " ")).otherwise(o)))

    return F.transform("operations", clean)


def _does(*operations: str, among: Column | None = None) -> Column:
    return F.arrays_overlap(F.col("__ops") if among is None else among, F.array(*[F.lit(o) for o in operations]))


def _measure(name: str) -> Column:
    """The largest `NAME:n` among the operations, 0 without one; NULL when n is no count."""
    def counted() -> Column:
        texts = F.filter(F.col("__ops"), lambda o: F.trim(F.substring_index(o, ":", 1)) == name)
        numbers = F.transform(texts, lambda o: F.trim(F.substring_index(o, ":", -1)).try_cast("int"))
        bad = F.exists(numbers, lambda n: n.isNull() | (n < 0))
        return F.when(~F.coalesce(bad, F.lit(False)), F.coalesce(F.array_max(numbers), F.lit(0)))

    # Few statements carry such an operation; the others skip the list work.
    return F.when(F.array_join("__ops", " ").contains(name), counted()).otherwise(0)


def _threshold(rule: str, name: str, configured: bool, fallback: Column | None = None) -> Column:
    default = F.lit(float(DEFAULTS[name])) if fallback is None else fallback
    if not configured:
        return default
    return F.coalesce(F.col("config").getItem(rule)["thresholds"].getItem(name), default)


def _has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def table_facts(signals: DataFrame, metadata: DataFrame, ids: Sequence[str] = ("id",)) -> DataFrame:
    """Index and size facts of the tables that writes and structure changes touch.

    `metadata`: table_name, has_index, row_count. Only the statements that two rules ask about
    are exploded; a table the metadata does not know counts as unknown.
    """
    asked = signals.filter(
        (F.col("dialect") == "postgres") & (_stmt("UPDATE", "DELETE") | _does("ALTER TABLE", "CREATE INDEX", among=_operations()))
    )
    return _facts_of(asked.select(*ids, "tables"), metadata, ids)


def _facts_of(lists: DataFrame, metadata: DataFrame, ids: Sequence[str]) -> DataFrame:
    each = lists.select(*ids, F.explode("tables").alias("table_name")).join(metadata, "table_name", "left")
    return each.groupBy(*ids).agg(
        F.bool_or(~F.coalesce("has_index", F.lit(False))).alias("unindexed_table"),
        F.max("row_count").alias("largest_table"),
        F.bool_or(F.col("row_count").isNull()).alias("unsized_table"),
    )


def with_facts(signals: DataFrame, agents: DataFrame, resolved: DataFrame, metadata: DataFrame, limited: DataFrame | None = None) -> DataFrame:
    """Signals with every fact the rules ask for: level, table facts, refused access, and rate limits where given.

    `resolved`: see policy.resolve_policies; `metadata`: see table_facts; `limited`: ids of refused requests. Access is
    settled once for each distinct request (who, where, tables, projected columns) and table facts once for each
    distinct list of tables, so a log is only joined to these, never exploded itself.
    """
    known = with_agents(spread(signals), agents)
    projected = F.when(F.upper("stmt_type") == "SELECT", policy.projected_columns(F.col("operations")))
    # A struct is never null itself, so requests with a null in them meet their row too.
    request = F.struct(*policy.POLICY_KEYS, "tables", projected.alias("projected"))
    lists = known.select(request.alias("__request")).distinct()
    asked = lists.select(
        "__request", *[F.col(f"__request.{c}").alias(c) for c in (*policy.POLICY_KEYS, "tables")],
        F.when(F.col("__request.projected").isNotNull(), "SELECT").alias("stmt_type"),
        F.transform("__request.projected", lambda c: F.concat(F.lit("SELECT_COLUMN:"), c)).alias("operations"),
    )
    tables = policy.table_access(asked, resolved, ["__request"]).filter(F.col("verdict") != "allowed").select("__request")
    columns = policy.column_access(asked, resolved, ["__request"]).select("__request")
    refused = tables.unionByName(columns).distinct().withColumn("access_refused", F.lit(True))
    of_tables = _facts_of(asked.select("tables").distinct().withColumn("__tables", F.struct("tables")), metadata, ["__tables"])
    joined = known.withColumns({"__request": request, "__tables": F.struct("tables")})
    joined = joined.join(refused, "__request", "left").join(of_tables, "__tables", "left").drop("__request", "__tables")
    if limited is not None:
        joined = joined.join(limited.select("id", F.lit(True).alias("rate_limited")), "id", "left")
    return joined


def prepared(signals: DataFrame) -> DataFrame:
    """Signals with the lists every rule reads put into one form, once per row."""
    names = F.transform(F.concat("functions", "operations"), lambda s: F.lower(F.substring_index(F.trim(s), ".", -1)))
    calls = F.transform("functions", lambda f: F.lower(F.trim(f)))
    listed = signals.withColumns({"__ops": _operations(), "__names": names, "__calls": calls})
    return listed.withColumns({"__nesting": _measure("NESTING_DEPTH"), "__unions": _measure("UNION_COUNT")})


def rule_columns(df: DataFrame) -> dict[str, Column]:
    """Decision text per rule where it hits, NULL where it does not."""
    configured = _has(df, "config")
    limit = lambda rule, name, fallback=None: _threshold(rule, name, configured, fallback)
    optional = lambda name, kind: F.col(name) if _has(df, name) else F.lit(None).cast(kind)

    write = _stmt("UPDATE", "DELETE")
    estimate = F.col("est_scan_rows")
    row_limit = F.coalesce(optional("datasource_row_limit", "double"), F.lit(float(DEFAULTS["row_limit"])))
    blocked_name = F.lit(False)
    for dialect, names in DANGEROUS_FUNCTIONS.items():
        hit = F.arrays_overlap("__names", F.array(*[F.lit(n) for n in names]))
        blocked_name = blocked_name | ((F.col("dialect") == dialect) & hit)
    admin_names = [prefix + f for f in ADMIN_FUNCTIONS for prefix in ("", "pg_catalog.")]
    admin_call = F.arrays_overlap("__calls", F.array(*[F.lit(f) for f in admin_names]))
    judged = (F.size("operations") > 0) & (~_stmt("UNKNOWN") | F.col("is_multi"))
    postgres = (F.col("dialect") == "postgres") & judged
    mysql = (F.col("dialect") == "mysql") & judged
    structural = _does("ALTER TABLE", "CREATE INDEX") & ~_does("CREATE INDEX CONCURRENTLY")
    no_table = F.size("tables") == 0
    in_tx = F.coalesce(optional("in_transaction", "boolean"), F.lit(False))
    age, idle, affected = (optional(n, "bigint") for n in ("tx_age_ms", "tx_idle_ms", "tx_affected_rows"))
    raw_bytes = F.octet_length(optional("sql_raw", "string"))
    over = lambda value, rule, name: F.coalesce(value > limit(rule, name), F.lit(False))

    unbounded = (
        ~F.col("has_limit")
        & ~(F.col("is_pure_aggregate") & ~F.col("has_group_by"))
        & F.coalesce(estimate > limit("R005", "row_limit", row_limit), F.lit(False))
    )
    conditions = {
        "R001": F.col("is_multi"),
        "R002": write & (~F.col("has_where") | F.col("where_tautology")),
        "R003": (F.lower(F.trim("level")) == "readonly") & ~_stmt("SELECT"),
        "R004": over(estimate, "R004", "max_scan_rows"),
        "R005": _stmt("SELECT") & (F.coalesce(F.col("truncated"), F.lit(False)) | unbounded),
        "R006": F.col("is_multi") | _stmt("UNKNOWN") | _does("SQL_COMMENT"),
        "R007": blocked_name,
        "R008": F.coalesce(optional("rate_limited", "boolean"), F.lit(False)),
        "R009": over(raw_bytes, "R009", "max_sql_length")
        | over(F.col("__nesting"), "R009", "max_nesting_depth")
        | over(F.col("__unions"), "R009", "max_union_count"),
        "R010": F.coalesce(optional("access_refused", "boolean"), F.lit(False)),
        "R101": postgres & _does(*DROP_OPERATIONS),
        "R102": postgres & _does(*LOCKING_OPERATIONS),
        "R103": postgres & admin_call,
        "R104": postgres & _does("COPY PROGRAM"),
        "R105": postgres & write & (no_table | F.coalesce(optional("unindexed_table", "boolean"), F.lit(True))),
        "R106": postgres & structural & (
            no_table
            | F.coalesce(optional("unsized_table", "boolean"), F.lit(True))
            | over(optional("largest_table", "bigint"), "R106", "large_table_rows")
        ),
        "R107": postgres & in_tx & (over(idle, "R107", "idle_transaction_ms") | over(age, "R107", "long_transaction_ms")),
        "R201": mysql & (_does(*FILE_OPERATIONS) | (_stmt("ADMIN") & _does("LOAD"))),
        "R202": mysql & write & ((F.size("tables") >= 2) | ~F.col("has_limit")),
        "R203": mysql & _does(*SERVER_OPERATIONS),
        "R204": mysql & in_tx & (age >= 0) & (affected >= 0) & (
            over(age, "R204", "mysql_transaction_age_ms") | over(affected, "R204", "mysql_transaction_affected_rows")
        ),
    }
    columns = {}
    for rule, condition in conditions.items():
        hit = F.when(F.coalesce(condition, F.lit(False)), RULE_LEVELS[rule])
        if configured:
            setting = F.col("config").getItem(rule)
            applies = _dialect_of(rule)
            forced = F.coalesce(setting["explicit_deny"], F.lit(False)) & applies
            enabled = F.coalesce(setting["enabled"], F.lit(True))
            hit = F.when(forced, "deny").when(enabled, hit)
        columns[rule] = hit
    return columns


def _dialect_of(rule: str) -> Column:
    if rule.startswith("R1"):
        return F.col("dialect") == "postgres"
    if rule.startswith("R2"):
        return F.col("dialect") == "mysql"
    return F.lit(True)


def invalid_signals() -> Column:
    """Rows no rule can judge; they are denied rather than passed."""
    known = (
        F.col("dialect").isin(*DIALECTS)
        & _stmt(*STATEMENTS)
        & F.lower(F.trim("level")).isin("readonly", "dml", "ddl")
        & (F.col("est_scan_rows").isNull() | (F.col("est_scan_rows") >= 0))
        & F.col("__nesting").isNotNull()
        & F.col("__unions").isNotNull()
    )
    return ~F.coalesce(known, F.lit(False))


def assess(signals: DataFrame) -> DataFrame:
    """Adds hits, decision, risk and the deciding rule to each row.

    Expected beside the signals: `level`; optional: unindexed_table, largest_table, unsized_table,
    access_refused, rate_limited, config. Works on a stream as it has no aggregation of its own.
    """
    staged = prepared(signals)
    decisions = {f"__{rule}": decision for rule, decision in rule_columns(staged).items()}
    staged = staged.withColumns({**decisions, "__invalid": invalid_signals()})
    # One number per hit: the strictest decision has the highest, and the first rule among equals.
    ranks = [_code(F.col(f"__{rule}"), PRIORITY) * 100 + (99 - i) for i, rule in enumerate(RULE_LEVELS)]
    staged = staged.withColumn("__top", F.greatest(*ranks))
    rule_ids = F.array(*[F.lit(rule) for rule in RULE_LEVELS])
    strictest = F.element_at(F.array(F.lit("warn"), F.lit("approve"), F.lit("deny")), F.floor(F.col("__top") / 100).cast("int"))
    decision = F.when(F.col("__invalid"), "deny").otherwise(F.when(F.col("__top").isNull(), "allow").otherwise(strictest))
    hits = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(f"__{rule}").isNotNull(),
                    F.struct(
                        F.lit(rule).alias("rule_id"), F.col(f"__{rule}").alias("decision"), _risk_of(rule, F.col(f"__{rule}")).alias("risk")
                    ),
                )
                for rule in RULE_LEVELS
            ]
        )
    )
    judged = staged.withColumns({"hits": hits, "decision": decision})
    added = ("hits", "decision", "risk", "reason_rule", "failed_closed")
    reason = F.when(~F.col("__invalid") & F.col("__top").isNotNull(), F.get(rule_ids, 99 - F.col("__top") % 100))
    return judged.select(
        *[c for c in signals.columns if c not in added],
        "hits",
        "decision",
        _code(F.col("decision"), RISK).alias("risk"),
        reason.alias("reason_rule"),
        F.col("__invalid").alias("failed_closed"),
    )


def _code(decision: Column, codes: dict[str, int]) -> Column:
    out = F.lit(None).cast("int")
    for name, code in codes.items():
        out = F.when(decision == name, code).otherwise(out)
    return out


def _risk_of(rule: str, decision: Column) -> Column:
    return F.when(decision == "deny", RISK["deny"]).otherwise(RISK[RULE_LEVELS[rule]])


def with_agents(signals: DataFrame, agents: DataFrame) -> DataFrame:
    return signals.join(agents.select("tenant_id", "agent_id", "level"), ["tenant_id", "agent_id"], "left")


def resolve_config(targets: DataFrame, layers: DataFrame) -> DataFrame:
    """Effective rule settings per (agent, data source) as one map column `config`.

    `layers`: layer (global, datasource, agent), scope_id, rule_id, enabled, explicit_deny and
    thresholds (map). An explicit deny in any layer holds; otherwise the narrowest layer wins. If `layers` has a
    `dialect`, an entry holds for that dialect only (null or `all`: for every one), and so does the result.
    """
    by_dialect = ["dialect"] if "dialect" in layers.columns else []
    target = ["agent_id", "datasource_id", *by_dialect]
    who = targets.select(*target).distinct()
    scopes = who.select(
        "*",
        F.inline(
            F.array(
                F.struct(F.lit("global").alias("layer"), F.lit("").alias("scope_id"), F.lit(1).alias("rank")),
                F.struct(F.lit("datasource").alias("layer"), F.col("datasource_id").alias("scope_id"), F.lit(2).alias("rank")),
                F.struct(F.lit("agent").alias("layer"), F.col("agent_id").alias("scope_id"), F.lit(3).alias("rank")),
            )
        ),
    )
    known = layers.filter(F.col("rule_id").isin(*RULE_LEVELS))
    if by_dialect:
        known = known.withColumnRenamed("dialect", "only")
    met = scopes.join(known, ["layer", "scope_id"])
    if by_dialect:
        met = met.filter(F.col("only").isNull() | (F.col("only") == "all") | (F.col("only") == F.col("dialect")))
    by_rule = met.groupBy(*target, "rule_id").agg(
        F.bool_or(F.coalesce("explicit_deny", F.lit(False))).alias("explicit_deny"),
        F.max_by("enabled", F.when(F.col("enabled").isNotNull(), F.col("rank"))).alias("enabled"),
    )
    limits = (
        met.select(*target, "rule_id", "rank", F.explode("thresholds").alias("name", "value"))
        .filter(F.col("name").isin(*DEFAULTS))
        .groupBy(*target, "rule_id", "name")
        .agg(F.max_by("value", "rank").alias("value"))
        .groupBy(*target, "rule_id")
        # Threshold names are a dozen fixed words, so each list is short.
        .agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("thresholds"))
    )
    joined = by_rule.join(limits, [*target, "rule_id"], "left")
    setting = F.struct(
        (F.col("explicit_deny") | F.coalesce("enabled", F.lit(True))).alias("enabled"),
        "explicit_deny",
        F.coalesce("thresholds", F.create_map().cast("map<string,double>")).alias("thresholds"),
    )
    # At most one entry per known rule.
    return joined.groupBy(*target).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("rule_id"), setting))).alias("config")
    )


def rule_quality(labelled: DataFrame) -> DataFrame:
    """Misses, false positives and their rate per rule and dialect from (expected, actual) hits."""
    expected, actual = F.col("expected"), F.col("actual")
    return labelled.groupBy("rule_id", "dialect").agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(expected & ~actual).alias("misses"),
        F.count_if(~expected & actual).alias("false_positives"),
        F.try_divide(F.count_if(~expected & actual), F.count_if(~expected)).alias("false_positive_rate"),
    ).withColumn("ok", (F.col("misses") == 0) & (F.coalesce("false_positive_rate", F.lit(0.0)) < 0.02))


def expected_rules(hits: DataFrame, ids: Sequence[str] = ("id",)) -> DataFrame:
    """Hit lists as (id, rule) rows."""
    return hits.select(*ids, F.explode("hits").alias("h")).select(*ids, "h.rule_id")


class TokenBucket:
    """One agent's bucket: refill by elapsed time, slots freed when a request ends.

    A request without a time has no place on the clock: it is refused as `no_time` and leaves the bucket as it is.
    """

    def __init__(self, qps: float, max_concurrent: int, state: dict | None = None):
        self.qps, self.limit, self.capacity = qps, max_concurrent, max(1.0, qps)
        self.tokens = state["tokens"] if state else self.capacity
        self.last = state["last"] if state else None
        self.ends = sorted(state["ends"]) if state else []

    def offer(self, now: float, duration: float, qps: float | None = None, max_concurrent: float | None = None) -> str:
        """'' when admitted, else the reason; concurrency is checked before tokens. Thresholds hold from here on."""
        if now != now:
            return "no_time"
        if qps is not None:
            self.qps, self.capacity = qps, max(1.0, qps)
        if max_concurrent is not None:
            self.limit = max_concurrent
        if self.last is not None:
            self.tokens = min(self.capacity, self.tokens + (now - self.last) * self.qps)
        self.last = now
        self.ends = [e for e in self.ends if e > now]
        if len(self.ends) >= self.limit:
            return "concurrency"
        if self.tokens < 1:
            return "qps"
        self.tokens -= 1
        self.ends.append(now + duration)
        return ""

    def state(self) -> dict:
        return {"tokens": self.tokens, "last": self.last, "ends": self.ends}

    def full_at(self) -> float | None:
        """When the bucket, left alone, is as a new one: all tokens back and all slots free."""
        if self.last is None:
            return None
        refill = (self.capacity - self.tokens) / self.qps if self.qps > 0 else float("inf")
        return max([self.last + max(0.0, refill), *self.ends])


def _bucket_step(qps: float, max_concurrent: int):
    def step(rows: pd.DataFrame, state: dict | None) -> tuple[pd.DataFrame, dict]:
        bucket = TokenBucket(qps, max_concurrent, state)
        reasons = [
            bucket.offer(at, ms / 1000.0, own_qps, own_limit)
            for at, ms, own_qps, own_limit in zip(rows["at_s"], rows["latency_ms"], rows["qps"], rows["max_concurrent"])
        ]
        out = rows[["tenant_id", "agent_id", "id"]].copy()
        out["limit_reason"] = reasons
        return out, bucket.state()

    return step


def limit_rows(log: DataFrame, qps: float, max_concurrent: int, *more: Column | str) -> DataFrame:
    """What a token bucket needs of a request: who, when, how long, and the thresholds that hold for it."""
    configured = _has(log, "config")
    own = lambda name, fallback: _threshold("R008", name, configured, F.lit(float(fallback))).cast("double")
    at = F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e6
    return log.select(
        "tenant_id", "agent_id", "id", "ts", at.alias("at_s"), F.coalesce("latency_ms", F.lit(0)).alias("latency_ms"),
        own("qps_per_agent", qps).alias("qps"), own("max_conns_per_datasource", max_concurrent).alias("max_concurrent"), *more,
    )


def rate_limits(
    log: DataFrame,
    qps: float = DEFAULTS["qps_per_agent"],
    max_concurrent: int = DEFAULTS["max_conns_per_datasource"],
    slice_unit: str = "hour",
    max_block_rows: int = MAX_BLOCK_ROWS,
) -> DataFrame:
    """Replay of the per-agent token bucket over a log: which requests would have been refused.

    Admission depends on every earlier request of the agent, so agents are folded in time order,
    a busy one in bounded blocks. Where the log has a `config` (see resolve_config), the thresholds of rule R008
    in it hold for the row instead of `qps` and `max_concurrent`.
    """
    return ordered_fold(*_limit_fold(log, qps, max_concurrent, slice_unit), max_block_rows)


def rate_limit_states(
    log: DataFrame,
    qps: float = DEFAULTS["qps_per_agent"],
    max_concurrent: int = DEFAULTS["max_conns_per_datasource"],
    slice_unit: str = "hour",
    max_block_rows: int = MAX_BLOCK_ROWS,
) -> DataFrame:
    """tenant_id, agent_id and the bucket's `state` after the log: a live rate limit can start from it."""
    return ordered_states(*_limit_fold(log, qps, max_concurrent, slice_unit), max_block_rows)


def _limit_fold(log: DataFrame, qps: float, max_concurrent: int, slice_unit: str) -> tuple:
    fields = (("tenant_id", T.StringType()), ("agent_id", T.StringType()), ("id", T.LongType()), ("limit_reason", T.StringType()))
    output = T.StructType([T.StructField(n, k) for n, k in fields])
    slim = limit_rows(log, qps, max_concurrent)
    return slim, ["tenant_id", "agent_id"], ["ts", "id"], time_slice("ts", slice_unit), _bucket_step(qps, max_concurrent), output
