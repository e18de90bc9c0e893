"""Policies over tables of objects, logs, users and grants.

Wildcards never become range joins: an object lists the few patterns that could name it, and
those meet the policies in an equi-join.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.hashing import row_digest, set_digest
from palisade.functions.segments import join_same, row_numbers, time_slice
from palisade.functions.text import utrim
from palisade.operators.recursion import leading_into_cycles, recurse
from palisade.session import materialize


def _blank(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) == ""


def object_patterns(schema: Column, table: Column) -> Column:
    """The patterns naming an object, as (pattern, level) with levels exact, schema, global."""
    has_schema = ~_blank(schema)
    exact = F.when(has_schema, F.concat(schema, F.lit("."), table)).otherwise(table)
    return F.array_compact(
        F.array(
            F.struct(exact.alias("pattern"), F.lit("exact").alias("level")),
            F.when(has_schema, F.struct(F.concat(schema, F.lit(".*")).alias("pattern"), F.lit("schema").alias("level"))),
            F.struct(F.lit("*").alias("pattern"), F.lit("global").alias("level")),
        )
    )


def valid_pattern(pattern: Column) -> Column:
    """`*`, `schema.*`, `schema.table` or `table`, without surrounding blanks."""
    return F.coalesce((utrim(pattern) == pattern) & pattern.rlike(r"^(\*|[^.]+|(?!\*\.)[^.]+\.[^.]+)$"), F.lit(False))


def match_objects(objects: DataFrame, policies: DataFrame) -> DataFrame:
    """Objects with every policy whose pattern names them, and at which level."""
    patterned = objects.select("*", F.inline(object_patterns(F.col("schema_name"), F.col("table_name"))))
    return patterned.join(policies.withColumnRenamed("object_name", "pattern"), "pattern")


POLICY_KEYS = ("tenant_id", "agent_id", "datasource_id")


def resolve_policies(policies: DataFrame) -> DataFrame:
    """Effective entries per agent in long form: allow, deny and column rows.

    A deny removes the identical allow pattern; column grants are united, each with the
    position of its first mention. Key scopes are left to `key_access`.
    """
    keys = list(POLICY_KEYS)
    tables = policies.filter(~F.col("object_type").isin("column", "key", "key_field"))
    denies = tables.filter(F.col("action") == "deny").select(*keys, F.col("object_name").alias("pattern")).distinct()
    allows = tables.filter(F.col("action") == "allow").select(*keys, F.col("object_name").alias("pattern")).distinct()
    kept = allows.join(denies, [*keys, "pattern"], "left_anti")
    names = F.transform(F.split("columns", ","), lambda n: F.trim(n))
    columns = (
        policies.filter((F.col("object_type") == "column") & (F.col("action") == "allow"))
        .select(*keys, F.col("object_name").alias("pattern"), "policy_id", F.posexplode(names).alias("at", "column_name"))
        .filter(F.col("column_name") != "")
        .groupBy(*keys, "pattern", "column_name")
        .agg(F.min(F.struct("policy_id", "at")).alias("first_mention"))
    )
    entry = lambda df, kind: df.select(
        *keys, F.lit(kind).alias("kind"), "pattern", F.lit(None).cast("string").alias("column_name")
    )
    return (
        entry(kept, "allow")
        .unionByName(entry(denies, "deny"))
        .unionByName(columns.select(*keys, F.lit("column").alias("kind"), "pattern", "column_name"))
    )


def _table_patterns(log: DataFrame, ids: Sequence[str]) -> DataFrame:
    """One row per (query, table, pattern); table names are `schema.table` or `table`."""
    each = log.select(*ids, *POLICY_KEYS, F.posexplode("tables").alias("table_at", "object_name"))
    dotted = F.col("object_name").contains(".")
    schema = F.when(dotted, F.substring_index("object_name", ".", 1)).otherwise("")
    table = F.when(dotted, F.substring_index("object_name", ".", -1)).otherwise(F.col("object_name"))
    return each.select("*", F.inline(object_patterns(schema, table)))


def table_access(log: DataFrame, resolved: DataFrame, ids: Sequence[str] = ("id",)) -> DataFrame:
    """Per query: denied (explicitly), not_allowed or allowed, over all its tables."""
    keys = list(POLICY_KEYS)
    rules = resolved.filter(F.col("kind") != "column").select(*keys, "pattern", "kind")
    judged = _table_patterns(log, ids).join(rules, [*keys, "pattern"], "left")
    per_table = judged.groupBy(*ids, "table_at").agg(
        F.bool_or(F.coalesce(F.col("kind") == "deny", F.lit(False))).alias("denied"),
        F.bool_or(F.coalesce(F.col("kind") == "allow", F.lit(False))).alias("allowed"),
    )
    return per_table.groupBy(*ids).agg(
        F.when(F.bool_or("denied"), "denied").when(F.bool_and("allowed"), "allowed").otherwise("not_allowed").alias("verdict")
    )


SELECT_COLUMN = "select_column"


def projected_columns(operations: Column) -> Column:
    """Projected column names from `SELECT_COLUMN:name` operations, distinct, in order."""
    parts = F.filter(operations, lambda o: F.lower(F.trim(F.substring_index(o, ":", 1))) == SELECT_COLUMN)
    return F.array_distinct(F.transform(parts, lambda o: F.trim(F.regexp_replace(o, r"^[^:]*:", ""))))


def column_access(log: DataFrame, resolved: DataFrame, ids: Sequence[str] = ("id",)) -> DataFrame:
    """Columns a single-table SELECT projects outside its column grant; a star is always outside.

    Tables under a wildcard allow, and tables without a column grant, are not constrained.
    """
    keys = list(POLICY_KEYS)
    single = log.filter((F.upper("stmt_type") == "SELECT") & (F.size("tables") == 1)).select(
        *ids, *keys, F.get("tables", F.lit(0)).alias("object_name"), projected_columns(F.col("operations")).alias("projected")
    )
    schema = F.when(F.col("object_name").contains("."), F.substring_index("object_name", ".", 1))
    acl = resolved.filter(F.col("kind") == "column").select(*keys, F.col("pattern").alias("object_name"), "column_name")
    free = acl.filter(F.col("column_name") == "*").select(*keys, "object_name").distinct()
    broad = resolved.filter((F.col("kind") == "allow") & F.col("pattern").endswith("*")).select(
        *keys, F.col("pattern").alias("broad")
    )
    constrained = (
        single.join(acl.select(*keys, "object_name").distinct(), [*keys, "object_name"], "left_semi")
        .join(free, [*keys, "object_name"], "left_anti")
        .withColumn("broad", F.lit("*"))
        .join(broad, [*keys, "broad"], "left_anti")
        .withColumn("broad", F.coalesce(F.concat(schema, F.lit(".*")), F.lit("")))
        .join(broad, [*keys, "broad"], "left_anti")
        .drop("broad")
    )
    exploded = constrained.select(*ids, *keys, "object_name", F.explode("projected").alias("column_name"))
    return exploded.join(acl, [*keys, "object_name", "column_name"], "left_anti").select(*ids, "object_name", "column_name")


# Reasons in the order they are decided.
REASONS = (
    "AUTH_AGENT_DENIED", "AUTH_STATEMENT_CLASS_DENIED", "AUTH_DATASOURCE_UNSUPPORTED", "AUTH_RELATION_DENIED",
    "AUTH_ROW_FILTER_UNSUPPORTED", "AUTH_RELATION_GRANT_MISSING", "AUTH_IDENTITY_UNPROVEN",
    "AUTH_COLUMN_GRANT_MISSING", "AUTH_MASK_MEET_UNDEFINED", "AUTH_MASK_CAPABILITY_MISSING",
)


def authorize_uses(
    requests: DataFrame,
    uses: DataFrame,
    policies: DataFrame,
    grants: DataFrame,
    masks: DataFrame | None = None,
) -> DataFrame:
    """One decision per request, with the first failing reason in the fixed order.

    `requests`: query_id, agent_id, datasource_id, agent_active, level, stmt_type,
    datasource_supported, identity_complete, applied_filter (object name or NULL).
    `uses`: query_id, schema_name, table_name, ordinal, column_name, type_digest, usage.
    `policies`: policy_id, agent_id, datasource_id ('' for any), object_type, object_name, action,
    row_filter. `grants`: policy_id, ordinal, column_name, type_digest, usage.
    `masks`: output of `meet_masks`.
    """
    scope = ["agent_id", "datasource_id"]
    who = requests.select("query_id", *scope)
    asked = uses.join(who, "query_id")
    relation_key = [*scope, "schema_name", "table_name"]
    # A policy may leave agent or data source open or use a wildcard, so a relation asks for every spelling of its
    # scope. Each distinct relation and use is settled once; the log itself is never multiplied.
    scopes = F.array_distinct(
        F.array(*[F.struct(a.alias("agent_id"), s.alias("datasource_id")) for a in (F.col("agent_id"), F.lit("")) for s in (F.col("datasource_id"), F.lit(""))])
    )
    patterns = object_patterns(F.col("schema_name"), F.col("table_name"))

    def sought(df: DataFrame, columns: Sequence[str]) -> DataFrame:
        """Rows with every scope and pattern a policy for them could carry, as s_agent, s_source and pattern."""
        spread = df.select(*columns, F.explode(scopes).alias("s"), patterns.alias("p"))
        return spread.select(*columns, F.col("s.agent_id").alias("s_agent"), F.col("s.datasource_id").alias("s_source"), F.explode("p.pattern").alias("pattern"))

    rules = policies.withColumnsRenamed({"object_name": "pattern", "agent_id": "s_agent", "datasource_id": "s_source"})
    allow = F.col("action") == "allow"
    key = ["s_agent", "s_source", "pattern"]
    # Policies are folded to one row per scope and pattern before anything is joined to them.
    folded = rules.groupBy(*key).agg(
        F.bool_or((F.col("action") == "deny") & (F.col("object_type") != "column")).alias("denied"),
        F.bool_or(allow).alias("granted"),
        F.bool_or(F.col("row_filter").isNotNull()).alias("filtered"),
        F.bool_or(
            F.col("row_filter").isNotNull()
            & ~((F.col("object_type") == "table") & allow & F.col("pattern").contains(".") & ~F.col("pattern").endswith("*"))
        ).alias("bad_filter"),
    )
    full_name = F.concat_ws(".", "schema_name", "table_name")
    flags = ("denied", "granted", "filtered", "bad_filter")
    relations = asked.select("query_id", *relation_key).distinct()
    per_relation = sought(relations.select(*relation_key).distinct(), relation_key).join(folded, key).groupBy(*relation_key).agg(
        *[F.bool_or(f).alias(f) for f in flags]
    )
    relation_facts = relations.join(per_relation, relation_key, "left").groupBy("query_id").agg(
        F.bool_or(F.coalesce("denied", F.lit(False))).alias("denied"),
        F.bool_and(F.coalesce("granted", F.lit(False))).alias("granted"),
        F.bool_or(F.coalesce("filtered", F.lit(False))).alias("filtered"),
        F.bool_or(F.coalesce("bad_filter", F.lit(False))).alias("bad_filter"),
        F.count(F.lit(1)).alias("relation_count"),
        F.max(F.when(F.col("filtered"), full_name)).alias("filtered_name"),
    )
    part = ["ordinal", "column_name", "type_digest", "usage"]
    use_key = [*relation_key, *part]
    granted = rules.filter(allow).select("policy_id", *key).join(grants, "policy_id").select(*key, *part).distinct()
    granted_uses = sought(asked.select(*use_key).distinct(), use_key).join(granted, [*key, *part], "left_semi").select(*use_key).distinct()
    missing = asked.join(granted_uses, use_key, "left_anti").groupBy("query_id").agg(F.count(F.lit(1)).alias("missing"))
    joined = requests.join(relation_facts, "query_id", "left").join(missing, "query_id", "left")
    if masks is not None:
        mask_reason = masks.filter(F.col("reason") != "ALLOW").groupBy("query_id").agg(
            F.min_by("reason", "output_index").alias("mask_reason")
        )
        joined = joined.join(mask_reason, "query_id", "left")
    else:
        joined = joined.withColumn("mask_reason", F.lit(None).cast("string"))
    unapplied = F.coalesce(F.col("filtered"), F.lit(False)) & (
        F.col("bad_filter") | (F.col("relation_count") != 1) | ~F.coalesce(F.col("applied_filter") == F.col("filtered_name"), F.lit(False))
    )
    stray = F.col("applied_filter").isNotNull() & ~F.coalesce(F.col("filtered"), F.lit(False))
    reason = F.coalesce(
        F.when(~F.col("agent_active") | ~F.col("level").isin("readonly", "dml", "ddl"), REASONS[0]),
        F.when(F.upper("stmt_type") != "SELECT", REASONS[1]),
        F.when(~F.col("datasource_supported"), REASONS[2]),
        F.when(F.coalesce("denied", F.lit(False)), REASONS[3]),
        F.when(unapplied | stray, REASONS[4]),
        F.when(~F.coalesce("granted", F.lit(True)), REASONS[5]),
        F.when(~F.col("identity_complete"), REASONS[6]),
        F.when(F.col("missing") > 0, REASONS[7]),
        F.concat(F.lit("AUTH_"), F.col("mask_reason")),
        F.lit("ALLOW"),
    )
    return joined.select("query_id", (reason == "ALLOW").alias("allowed"), reason.alias("reason"))


def hide_columns(df: DataFrame, disabled: Sequence[str]) -> DataFrame:
    """The frame without its disabled fields; names are compared without case."""
    hidden = {c.lower() for c in disabled}
    return df.select(*[c for c in df.columns if c.lower() not in hidden])


def _digest_columns(policies: DataFrame) -> list[str]:
    return sorted(c for c in policies.columns if c != "tenant_id")


def policy_digest(policies: DataFrame) -> DataFrame:
    """One digest per tenant over all its policies; row order does not matter."""
    digest = row_digest(_digest_columns(policies))
    return policies.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("policies"), F.concat(F.lit("sha256:"), set_digest(digest)).alias("digest")
    )


def policy_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Created, updated and deleted policies and whether each change could widen access."""
    keys = ["tenant_id", "policy_id"]
    columns = [c for c in _digest_columns(before) if c != "revision"] + (["revision"] if "revision" in before.columns else [])
    side = lambda df, name: df.select(
        *keys, F.struct("action", "revision", row_digest(columns).alias("digest")).alias(name)
    )
    joined = side(before, "b").join(side(after, "a"), keys, "full_outer")
    operation = F.when(F.col("b").isNull(), "create").when(F.col("a").isNull(), "delete").when(
        F.col("a.digest") != F.col("b.digest"), "update"
    )
    widens = F.when(F.col("a").isNull(), F.col("b.action") == "deny").otherwise(F.col("a.action") == "allow")
    return joined.select(
        *keys,
        operation.alias("operation"),
        widens.alias("broadens_grant"),
        F.col("b.revision").alias("from_revision"),
        F.col("a.revision").alias("to_revision"),
    ).filter(F.col("operation").isNotNull())


def _replay(policies: DataFrame, probes: DataFrame, name: str) -> DataFrame:
    scope = ["tenant_id", "agent_id", "datasource_id"]
    plain = (F.col("object_type") == "table") & F.col("columns").isNull() & F.col("row_filter").isNull()
    opaque = policies.filter(~plain | ~F.col("action").isin("allow", "deny")).select(*scope).distinct().withColumn("opaque", F.lit(True))
    # Policies are folded to one row per scope and pattern, so a probe meets at most one for each of its patterns.
    folded = policies.groupBy(*scope, F.col("object_name").alias("pattern")).agg(
        F.bool_or(F.col("action") == "deny").alias("deny"), F.bool_or(F.col("action") == "allow").alias("allow")
    )
    hits = (
        probes.select("probe_id", *scope, F.inline(object_patterns(F.col("schema_name"), F.col("table_name"))))
        .join(folded, [*scope, "pattern"])
        .groupBy("probe_id")
        .agg(F.bool_or("deny").alias("deny"), F.bool_or("allow").alias("allow"))
    )
    decided = probes.select("probe_id", *scope).join(opaque, scope, "left").join(hits, "probe_id", "left")
    verdict = F.when(F.col("opaque"), "unknown").when(F.col("deny"), "deny").when(F.col("allow"), "candidate").otherwise("deny")
    return decided.select("probe_id", verdict.alias(name))


def policy_replay(before: DataFrame, after: DataFrame, probes: DataFrame) -> DataFrame:
    """Verdicts on exact object probes under two policy sets: deny, candidate or unknown."""
    return _replay(before, probes, "before").join(_replay(after, probes, "after"), "probe_id")


def effective_permissions(roles: DataFrame, parents: DataFrame, permissions: DataFrame, user_roles: DataFrame) -> DataFrame:
    """Permissions per user through inherited roles, and users whose roles cannot be trusted.

    A user who reaches an unknown role or a cycle is forbidden: one row with `forbidden` set and
    no permission. `roles`: role_id; `parents`: role_id, parent_id; `permissions`: role_id, permission. Only the
    roles that users hold are followed upwards, so no pairs of roles are kept; users who hold the same roles share one
    set of them, which is followed once.
    """
    own = user_roles.select("user_id", "role_id").repartition("user_id").distinct()
    in_set = F.unhex(F.substring(set_digest(row_digest(["role_id"])), 1, 32))
    members = materialize(own.groupBy("user_id").agg(in_set.alias("set_id")), "role-sets")
    edges = parents.select("role_id", "parent_id").distinct()
    reached = recurse(
        join_same(own, members, ["user_id"]).select("set_id", "role_id"),
        lambda held: held.join(edges, "role_id").select("set_id", F.col("parent_id").alias("role_id")),
        distinct=True,
    )
    unknown = reached.join(roles.select("role_id").distinct(), "role_id", "left_anti").select("set_id")
    looping = reached.join(leading_into_cycles(edges, "role_id", "parent_id"), "role_id", "left_semi").select("set_id")
    bad = unknown.unionByName(looping).distinct()
    forbidden = members.join(bad, "set_id", "left_semi")
    # A user without an id is not told from others without one, so nobody's roles forbid that user the own permissions.
    trusted = members.filter(F.col("user_id").isNotNull()).join(bad, "set_id", "left_anti").unionByName(members.filter(F.col("user_id").isNull()))
    held = (
        reached.join(permissions, "role_id")
        .select("set_id", "permission")
        .distinct()
        .join(trusted, "set_id")
        .select("user_id", "permission")
        .withColumn("forbidden", F.lit(False))
    )
    return held.unionByName(
        forbidden.select("user_id", F.lit(None).cast("string").alias("permission"), F.lit(True).alias("forbidden"))
    )


def delegation_violations(requested: DataFrame, held: DataFrame) -> DataFrame:
    """Permissions a user tries to hand on without holding them."""
    return requested.join(held.select("user_id", "permission").distinct(), ["user_id", "permission"], "left_anti")


# Shape of a key scope and of a hash field name.
KEY_SCOPE = r"^db(0|[1-9]|1[0-5]):[A-Za-z0-9][A-Za-z0-9:_-]{2,126}\*?$"
HASH_FIELD = r"^[A-Za-z][A-Za-z0-9_]{0,63}$"
# Fixed value: the longest text the scope pattern allows.
_LONGEST_SCOPE = 131


def key_access(keys: DataFrame, scopes: DataFrame) -> DataFrame:
    """Whether each key is granted: exact or prefix scopes, any deny wins.

    `keys`: key_id, agent_id, db, key; `scopes`: agent_id, scope, action. A prefix scope meets a
    key through the key's own prefixes, taken only at the lengths that scopes really have.
    """
    valid = scopes.filter(F.col("scope").rlike(KEY_SCOPE))
    prefixes = valid.filter(F.col("scope").endswith("*")).select("agent_id", F.expr("rtrim('*', scope)").alias("probe"), "action")
    exact = valid.filter(~F.col("scope").endswith("*")).select("agent_id", F.col("scope").alias("probe"), "action")
    # Scope text is at most 131 characters, so this list of lengths is short.
    lengths = prefixes.agg(F.collect_set(F.length("probe"))).scalar()
    target = F.concat(F.lit("db"), F.col("db").cast("string"), F.lit(":"), F.col("key"))
    probed = keys.withColumn("__target", target).withColumn(
        "__ok", F.col("__target").rlike(KEY_SCOPE) & ~F.col("key").contains("*")
    )
    exact_hits = probed.select("key_id", "agent_id", F.col("__target").alias("probe")).join(exact, ["agent_id", "probe"])
    own = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length("__target"), F.lit(_LONGEST_SCOPE))))
    cut = F.transform(F.array_intersect("__lengths", own), lambda n: F.left("__target", n))
    prefix_hits = probed.withColumn("__lengths", lengths).select("key_id", "agent_id", F.explode(cut).alias("probe")).join(
        prefixes.distinct(), ["agent_id", "probe"]
    )
    hits = exact_hits.select("key_id", "action").unionByName(prefix_hits.select("key_id", "action"))
    verdicts = hits.groupBy("key_id").agg(
        F.bool_or(F.col("action") == "deny").alias("denied"), F.bool_or(F.col("action") == "allow").alias("allowed")
    )
    granted = F.coalesce(F.col("__ok") & F.col("allowed") & ~F.col("denied"), F.lit(False))
    return probed.join(verdicts, "key_id", "left").select("key_id", granted.alias("granted"))


def hash_field_access(requests: DataFrame, scopes: DataFrame, field_grants: DataFrame) -> DataFrame:
    """Field requests that pass: the key is granted exactly (not by prefix alone) and the field is named.

    `requests`: key_id, agent_id, db, key, field; `field_grants`: agent_id, key_scope, field.
    """
    by_key = key_access(requests.select("key_id", "agent_id", "db", "key").distinct(), scopes).filter("granted")
    exact = scopes.filter((F.col("action") == "allow") & ~F.col("scope").endswith("*")).select(
        "agent_id", F.col("scope").alias("key_scope")
    ).distinct()
    target = F.concat(F.lit("db"), F.col("db").cast("string"), F.lit(":"), F.col("key"))
    return (
        requests.filter(F.col("field").rlike(HASH_FIELD))
        .withColumn("key_scope", target)
        .join(by_key, "key_id", "left_semi")
        .join(exact, ["agent_id", "key_scope"], "left_semi")
        .join(field_grants.distinct(), ["agent_id", "key_scope", "field"], "left_semi")
        .select("key_id", "field")
    )


def valid_grants(grants: DataFrame, agents: DataFrame, users: DataFrame, tenants: DataFrame, at: dt.datetime) -> DataFrame:
    """Grants usable at a moment: live agent, issuer and tenant, not revoked, not expired, uses left."""
    now = F.lit(at)
    kind = lambda df, c: now.cast(df.schema[c].dataType)
    open_grants = grants.filter(
        F.col("revoked_at").isNull()
        & (F.col("expires_at") > kind(grants, "expires_at"))
        & (F.col("max_uses").isNull() | (F.col("used_count") < F.col("max_uses")))
    )
    live_agents = agents.filter(
        (F.col("status") == "active")
        & (F.col("expires_at").isNull() | (F.col("expires_at") > kind(agents, "expires_at")))
    )
    return (
        open_grants.join(live_agents, ["tenant_id", "agent_id"], "left_semi")
        .join(users.filter(F.col("status") == "active"), ["tenant_id", "issuer_id"], "left_semi")
        .join(tenants.filter(F.col("status") == "active"), "tenant_id", "left_semi")
    )


def matching_grants(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """Requests covered by a grant for the same agent, data source and exact statement text."""
    digest = F.sha2(F.col("sql_raw"), 256)
    keys = ["tenant_id", "agent_id", "datasource_id", "sql_sha256"]
    return requests.withColumn("sql_sha256", digest).join(grants.select(*keys, "grant_id"), keys)


def grant_usage(log: DataFrame, grants: DataFrame, slice_unit: str = "hour") -> DataFrame:
    """Replay of uses in time order: the n-th use of a grant passes while uses are left.

    The use number is counted in time slices, so one busy grant does not fill one task.
    """
    numbered = row_numbers(log, ["grant_id"], ["ts", "id"], time_slice("ts", slice_unit), "use_no")
    return numbered.join(grants.select("grant_id", "max_uses"), "grant_id", "left").withColumn(
        "granted", F.coalesce(F.col("use_no") <= F.col("max_uses"), F.lit(False))
    )


def policy_health(policies: DataFrame, staged: DataFrame, bindings: DataFrame, grants: DataFrame) -> DataFrame:
    """Counts of staged rows, incomplete and unhealthy bindings, and grants left without a binding."""
    filled = bindings.filter(~_blank("stable_object_id") & ~_blank("catalog_fingerprint"))
    incomplete = policies.filter(F.col("object_type") == "column").join(
        filled.select(F.col("binding_id").alias("relation_binding_id"), "policy_id"), ["relation_binding_id", "policy_id"], "left_anti"
    )
    unhealthy = bindings.filter(F.col("status") != "healthy").join(policies, "policy_id", "left_semi")
    healthy = bindings.filter(F.col("status") == "healthy").select("binding_id", "policy_id")
    orphaned = grants.join(policies, "policy_id", "left_semi").join(healthy, ["binding_id", "policy_id"], "left_anti")
    counted = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("finding"), "n")
    return (
        counted(staged.join(policies, "policy_id", "left_semi"), "staged_rows")
        .unionByName(counted(incomplete, "incomplete_bindings"))
        .unionByName(counted(unhealthy, "unhealthy_bindings"))
        .unionByName(counted(orphaned, "orphaned_grants"))
    )


def promote_policies(
    source: DataFrame, policy_map: DataFrame, agent_map: DataFrame, datasource_map: DataFrame, target: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Policies carried to another environment, and the ones that cannot be.

    `policy_map`: policy_id, target_id, target_object; `agent_map` and `datasource_map`: old and new ids.
    Returns (planned, problems); problems name a missing mapping or a target id used twice.
    """
    mapped = (
        source.join(policy_map, "policy_id", "left").join(agent_map, "agent_id", "left").join(datasource_map, "datasource_id", "left")
    )
    gap = _blank("target_id") | _blank("target_agent") | _blank("target_datasource") | _blank("target_object")
    bad_object = F.col("target_object").contains("*") | ~valid_pattern(F.col("target_object"))
    complete = mapped.filter(~gap & ~bad_object)
    uses = complete.groupBy("target_id").agg(F.count(F.lit(1)).alias("n"))
    collisions = complete.join(uses.filter(F.col("n") > 1), "target_id", "left_semi")
    problems = (
        mapped.filter(gap).select("policy_id", F.lit("incomplete_mapping").alias("problem"))
        .unionByName(mapped.filter(~gap & bad_object).select("policy_id", F.lit("invalid_object").alias("problem")))
        .unionByName(collisions.select("policy_id", F.lit("target_not_unique").alias("problem")))
    )
    existing = target.select(F.col("policy_id").alias("target_id"), F.col("revision").alias("target_revision"))
    planned = (
        complete.join(uses.filter(F.col("n") == 1), "target_id", "left_semi")
        .join(existing, "target_id", "left")
        .select(
            F.col("policy_id").alias("source_id"),
            F.col("target_id").alias("policy_id"),
            F.col("target_agent").alias("agent_id"),
            F.col("target_datasource").alias("datasource_id"),
            F.col("target_object").alias("object_name"),
            "object_type",
            "action",
            F.coalesce("target_revision", F.lit(0)).cast("int").alias("revision"),
            F.when(F.col("target_revision").isNull(), "create").otherwise("replace").alias("operation"),
        )
    )
    return planned, problems


def duplicate_rules(rules: DataFrame) -> DataFrame:
    """Rules that share a normalised scope, one row per rule with the size of its group.

    The long form keeps a very large group spread over many rows instead of one id list.
    """
    keyed = rules.withColumns(
        {
            "scope_key": F.coalesce(F.trim("datasource_id"), F.lit("")),
            "column_key": F.lower(F.trim("column_name")),
        }
    )
    groups = keyed.groupBy("scope_key", "column_key").agg(F.count(F.lit(1)).alias("n"), F.min("rule_id").alias("first_id"))
    return keyed.select("scope_key", "column_key", "rule_id").join(groups.filter(F.col("n") > 1), ["scope_key", "column_key"])
