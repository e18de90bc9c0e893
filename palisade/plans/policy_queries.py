"""Policy queries over derived policies, logs, roles, keys and grants."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from palisade.operators import policy as p
from palisade.operators import rows as rw
from palisade.plans.registry import over_audit, over_signals, query, with_ctes
from palisade.sources import tables as t

POLICIES = f"policies AS ({t.POLICIES_SQL})"
_OBJECTS = """SELECT o_orderkey AS object_id, CASE o_custkey % 4 WHEN 0 THEN 'sales' WHEN 1 THEN 'hr' WHEN 2 THEN '' ELSE 'x' END AS schema_name,
 CASE o_custkey % 4 WHEN 0 THEN CASE o_orderkey % 3 WHEN 0 THEN 'orders' WHEN 1 THEN 'lineitem' ELSE 'other' END WHEN 1 THEN 'salaries'
  WHEN 2 THEN 'events' ELSE concat('t', CAST(o_orderkey % 50 AS STRING)) END AS table_name FROM orders"""
OBJECTS = f"objects AS ({_OBJECTS})"


def _objects(spark, d):
    return t.select_over(spark, _OBJECTS, "orders", t.load(spark, d, "orders"))


_HIT = "(pattern = '*' OR (schema_name <> '' AND pattern = schema_name || '.*') OR pattern = CASE WHEN schema_name <> '' THEN schema_name || '.' || table_name ELSE table_name END)"


@query("match_objects", with_ctes(f"""
SELECT level, pattern, count(*) AS n, count(DISTINCT object_id) AS objects FROM (
 SELECT o.object_id, q.object_name AS pattern, CASE WHEN q.object_name = '*' THEN 'global' WHEN q.object_name LIKE '%.*' THEN 'schema' ELSE 'exact' END AS level
 FROM objects o JOIN policies q ON {_HIT.replace('pattern', 'q.object_name')}) GROUP BY 1, 2""", OBJECTS, POLICIES))
def match_objects(spark, d):
    """Counted per pattern over distinct patterns, so that a wildcard never multiplies the objects."""
    held = t.policies(spark, d)
    sizes = held.groupBy("object_name").agg(F.count(F.lit(1)).alias("policies"))
    matched = p.match_objects(_objects(spark, d), sizes)
    return matched.groupBy("level", "pattern").agg(F.sum("policies").alias("n"), F.countDistinct("object_id").alias("objects"))


_RESOLVED = """denies AS (SELECT DISTINCT tenant_id, agent_id, datasource_id, object_name AS pattern FROM policies WHERE object_type <> 'column' AND action = 'deny'),
 allows AS (SELECT DISTINCT tenant_id, agent_id, datasource_id, object_name AS pattern FROM policies WHERE object_type <> 'column' AND action = 'allow'
  EXCEPT SELECT * FROM denies),
 acl AS (SELECT DISTINCT tenant_id, agent_id, datasource_id, object_name AS pattern, trim(unnest(string_split(columns, ','))) AS column_name FROM policies WHERE object_type = 'column'),
 resolved AS (SELECT tenant_id, agent_id, datasource_id, 'allow' AS kind, pattern, NULL AS column_name FROM allows
  UNION ALL SELECT tenant_id, agent_id, datasource_id, 'deny', pattern, NULL FROM denies UNION ALL SELECT tenant_id, agent_id, datasource_id, 'column', pattern, column_name FROM acl)"""


@query("resolve_policies", with_ctes("SELECT * FROM resolved", POLICIES, _RESOLVED))
def resolve_policies(spark, d):
    return p.resolve_policies(t.policies(spark, d))


_LOG_TABLES = """uses AS (SELECT id, tenant_id, agent_id, datasource_id, unnest(list_filter([table_1, table_2], lambda x: x IS NOT NULL)) AS object_name FROM signals)"""
_VERDICTS = """verdicts AS (SELECT u.id, u.object_name, coalesce(bool_or(r.kind = 'deny'), false) AS denied, coalesce(bool_or(r.kind = 'allow'), false) AS allowed
 FROM uses u LEFT JOIN resolved r ON r.kind <> 'column' AND (r.tenant_id, r.agent_id, r.datasource_id) = (u.tenant_id, u.agent_id, u.datasource_id)
  AND (r.pattern = '*' OR r.pattern = u.object_name OR (contains(u.object_name, '.') AND r.pattern = split_part(u.object_name, '.', 1) || '.*')) GROUP BY 1, 2)"""


@query("table_access", over_signals("""
SELECT id, CASE WHEN bool_or(denied) THEN 'denied' WHEN bool_and(allowed) THEN 'allowed' ELSE 'not_allowed' END AS verdict FROM verdicts GROUP BY 1""",
    POLICIES, _RESOLVED, _LOG_TABLES, _VERDICTS))
def table_access(spark, d):
    return p.table_access(t.query_signals(spark, d), p.resolve_policies(t.policies(spark, d)))


REFUSED_COLUMNS = """
SELECT s.id, table_1 AS object_name, split_part(operation_2, ':', 2) AS column_name FROM signals s
WHERE stmt_type = 'SELECT' AND table_2 IS NULL
 AND EXISTS (SELECT 1 FROM acl a WHERE (a.tenant_id, a.agent_id, a.datasource_id, a.pattern) = (s.tenant_id, s.agent_id, s.datasource_id, table_1))
 AND NOT EXISTS (SELECT 1 FROM allows a WHERE (a.tenant_id, a.agent_id, a.datasource_id) = (s.tenant_id, s.agent_id, s.datasource_id)
  AND (a.pattern = '*' OR (contains(table_1, '.') AND a.pattern = split_part(table_1, '.', 1) || '.*')))
 AND NOT EXISTS (SELECT 1 FROM acl a WHERE (a.tenant_id, a.agent_id, a.datasource_id, a.pattern) = (s.tenant_id, s.agent_id, s.datasource_id, table_1) AND a.column_name = split_part(operation_2, ':', 2))"""


@query("column_access", over_signals(REFUSED_COLUMNS, POLICIES, _RESOLVED))
def column_access(spark, d):
    return p.column_access(t.query_signals(spark, d), p.resolve_policies(t.policies(spark, d)))


_REQUESTS = """SELECT o_orderkey AS query_id, concat('agent-', CAST(o_custkey % 20 AS STRING)) AS agent_id, concat('ds-', CAST(o_orderkey % 5 AS STRING)) AS datasource_id,
 o_custkey % 23 <> 0 AS agent_active, 'readonly' AS level, CASE WHEN o_custkey % 19 = 0 THEN 'DELETE' ELSE 'SELECT' END AS stmt_type,
 o_custkey % 29 <> 0 AS datasource_supported, o_custkey % 31 <> 0 AS identity_complete,
 CASE WHEN o_orderkey % 37 = 0 THEN 'sales.nothing' WHEN o_orderkey % 4 = 1 THEN 'sales.lineitem' END AS applied_filter, o_orderkey % 4 AS shape, o_custkey % 3 AS width FROM orders"""
_USES = """SELECT query_id, schema_name, table_name, ordinal, concat('c', CAST(ordinal AS STRING)) AS column_name, 'd1' AS type_digest,
 CASE WHEN ordinal = 2 THEN 'reference' ELSE 'output' END AS usage FROM (
 SELECT query_id, 'sales' AS schema_name, CASE shape WHEN 1 THEN 'lineitem' WHEN 2 THEN 'secret' ELSE 'orders' END AS table_name, 1 AS ordinal FROM requests
 UNION ALL SELECT query_id, 'sales', CASE shape WHEN 1 THEN 'lineitem' WHEN 2 THEN 'secret' ELSE 'orders' END, 2 FROM requests WHERE width > 0
 UNION ALL SELECT query_id, 'sales', 'orders', 3 FROM requests WHERE width > 1) AS each_use"""
_USE_POLICIES = """SELECT concat('p', CAST(s_suppkey % 20 AS STRING), '-', CAST(s_suppkey AS STRING)) AS policy_id, concat('agent-', CAST(s_suppkey % 20 AS STRING)) AS agent_id,
 CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE concat('ds-', CAST(s_suppkey % 5 AS STRING)) END AS datasource_id, 'table' AS object_type,
 CASE s_suppkey % 4 WHEN 1 THEN 'sales.lineitem' WHEN 2 THEN 'sales.secret' ELSE 'sales.orders' END AS object_name,
 CASE WHEN s_suppkey % 4 = 2 THEN 'deny' ELSE 'allow' END AS action, CASE WHEN s_suppkey % 4 = 1 THEN 'l_tax > 0' END AS row_filter FROM supplier"""
_GRANTS = """SELECT policy_id, ordinal, concat('c', CAST(ordinal AS STRING)) AS column_name, 'd1' AS type_digest, CASE WHEN ordinal = 2 THEN 'reference' ELSE 'output' END AS usage
 FROM (SELECT policy_id, 1 AS ordinal FROM use_policies UNION ALL SELECT policy_id, 2 FROM use_policies WHERE object_name = 'sales.orders') AS each_grant"""
_USE_HITS = """hits AS (SELECT u.query_id, u.schema_name || '.' || u.table_name AS rel, q.* FROM (SELECT DISTINCT query_id, schema_name, table_name FROM uses) u JOIN requests r USING (query_id)
  JOIN use_policies q ON q.agent_id IN ('', r.agent_id) AND q.datasource_id IN ('', r.datasource_id) AND q.object_name = u.schema_name || '.' || u.table_name),
 rels AS (SELECT query_id, schema_name || '.' || table_name AS rel FROM uses GROUP BY ALL),
 facts AS (SELECT r.query_id, bool_or(coalesce(denied, false)) AS denied, bool_and(coalesce(granted, false)) AS granted, bool_or(coalesce(filtered, false)) AS filtered,
  count(*) AS n, max(CASE WHEN filtered THEN r.rel END) AS filtered_name FROM rels r LEFT JOIN (SELECT query_id, rel, bool_or(action = 'deny') AS denied, bool_or(action = 'allow') AS granted,
   bool_or(row_filter IS NOT NULL) AS filtered FROM hits GROUP BY 1, 2) h ON h.query_id = r.query_id AND h.rel = r.rel GROUP BY 1),
 missing AS (SELECT DISTINCT u.query_id FROM uses u WHERE NOT EXISTS (SELECT 1 FROM hits h JOIN grants g ON g.policy_id = h.policy_id WHERE h.action = 'allow' AND h.query_id = u.query_id
  AND h.rel = u.schema_name || '.' || u.table_name AND g.ordinal = u.ordinal AND g.column_name = u.column_name AND g.usage = u.usage))"""


@query("authorize_uses", with_ctes("""
SELECT query_id, reason = 'ALLOW' AS allowed, reason FROM (SELECT r.query_id, CASE WHEN NOT agent_active THEN 'AUTH_AGENT_DENIED' WHEN stmt_type <> 'SELECT' THEN 'AUTH_STATEMENT_CLASS_DENIED'
  WHEN NOT datasource_supported THEN 'AUTH_DATASOURCE_UNSUPPORTED' WHEN denied THEN 'AUTH_RELATION_DENIED'
  WHEN (filtered AND (n <> 1 OR applied_filter IS NULL OR applied_filter <> filtered_name)) OR (NOT filtered AND applied_filter IS NOT NULL) THEN 'AUTH_ROW_FILTER_UNSUPPORTED'
  WHEN NOT granted THEN 'AUTH_RELATION_GRANT_MISSING' WHEN NOT identity_complete THEN 'AUTH_IDENTITY_UNPROVEN'
  WHEN m.query_id IS NOT NULL THEN 'AUTH_COLUMN_GRANT_MISSING' ELSE 'ALLOW' END AS reason
 FROM requests r JOIN facts f USING (query_id) LEFT JOIN missing m ON m.query_id = r.query_id)""",
    f"requests AS ({_REQUESTS})", f"uses AS ({_USES})", f"use_policies AS ({_USE_POLICIES})", f"grants AS ({_GRANTS})", _USE_HITS))
def authorize_uses(spark, d):
    requests = t.select_over(spark, _REQUESTS, "orders", t.load(spark, d, "orders"))
    uses = t.select_over(spark, _USES, "requests", requests)
    policies = t.select_over(spark, _USE_POLICIES, "supplier", t.load(spark, d, "supplier"))
    return p.authorize_uses(requests, uses, policies, t.select_over(spark, _GRANTS, "use_policies", policies))


FILTERS = (
    rw.AnyOf((rw.Compare("c_nationkey", "<", 10), rw.Compare("c_mktsegment", "=", "BUILDING"))),
    rw.AllOf((rw.Compare("c_acctbal", ">=", 0.0), rw.IsNull("c_name", negated=True))),
)


@query("row_filters", """
SELECT c_custkey, c_nationkey FROM customer WHERE (c_nationkey < 10 OR c_mktsegment = 'BUILDING') AND c_acctbal >= 0 AND c_name IS NOT NULL""")
def row_filters(spark, d):
    return rw.apply_row_filters(t.load(spark, d, "customer"), FILTERS).select("c_custkey", "c_nationkey")


TREE = {
    "logic": "or",
    "items": [
        {"type": "item", "field_id": 1, "filter_type": "logic", "term": "in", "value_type": "variable", "variable_id": 7},
        {"type": "tree", "sub_tree": {"logic": "and", "items": [
            {"type": "item", "field_id": 2, "filter_type": "logic", "term": "ge", "value": "400000", "value_type": "normal"},
            {"type": "item", "field_id": 3, "filter_type": "logic", "term": "not_eq", "value": "F"},
            {"type": "item", "field_id": 1, "filter_type": "logic", "term": "not_null"},
        ]}},
    ],
}


@query("row_rule_tree", """
SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') OR (o_totalprice >= 400000 AND o_orderstatus <> 'F' AND o_orderpriority IS NOT NULL)""")
def row_rule_tree(spark, d):
    fields = {1: "o_orderpriority", 2: "o_totalprice", 3: "o_orderstatus"}
    return rw.row_rule_filter(t.load(spark, d, "orders"), TREE, fields, {7: ["1-URGENT", "5-LOW"]}).select("o_orderkey", "o_orderpriority")


_RULES = "SELECT r_regionkey AS rule_id, r_regionkey % 2 AS variable_id, r_regionkey <> 3 AS enabled FROM region"
_TARGETS = "SELECT s_nationkey % 5 AS rule_id, concat('u', CAST(s_suppkey AS STRING)) AS user_id FROM supplier"
_BINDINGS = "SELECT concat('u', CAST(s_suppkey AS STRING)) AS user_id, s_suppkey % 3 AS variable_id, s_nationkey AS value FROM supplier"


@query("secure_rows", with_ctes("""
SELECT user_id, count(*) AS visible, round(sum(c_acctbal), 2) AS balance FROM customer JOIN (SELECT DISTINCT user_id, value FROM rules JOIN targets USING (rule_id) JOIN bindings USING (user_id, variable_id) WHERE enabled) e
 ON e.value = c_nationkey GROUP BY 1""", f"rules AS ({_RULES})", f"targets AS ({_TARGETS})", f"bindings AS ({_BINDINGS})"))
def secure_rows(spark, d):
    supplier = t.load(spark, d, "supplier")
    entitled = rw.entitlements(
        t.select_over(spark, _RULES, "region", t.load(spark, d, "region")),
        t.select_over(spark, _TARGETS, "supplier", supplier),
        t.select_over(spark, _BINDINGS, "supplier", supplier),
    )
    seen = rw.secure_totals(t.load(spark, d, "customer"), entitled, "c_nationkey", {"balance": "c_acctbal"})
    return seen.select("user_id", "visible", F.round("balance", 2).alias("balance"))


@query("hide_columns", "SELECT o_orderkey, o_orderstatus, o_orderdate, o_orderpriority FROM orders")
def hide_columns(spark, d):
    return p.hide_columns(t.load(spark, d, "orders"), ["O_CUSTKEY", "o_totalprice"])


_DIGEST_COLUMNS = ["action", "agent_id", "columns", "datasource_id", "object_name", "object_type", "policy_id", "revision", "row_filter"]


def digest_sql(columns, source):
    """Row digests and their order-free sums, in the other engine."""
    framed = " || ".join(
        f"coalesce(from_hex('01') || from_hex(lpad(to_hex(octet_length(encode({c}::VARCHAR))), 8, '0')) || encode({c}::VARCHAR), from_hex('0000000000'))" for c in columns
    )
    return f"(SELECT *, sha256({framed}) AS dg FROM {source})"


def set_digest_sql():
    words = " || ':' || ".join(f"sum(('0x' || substr(dg, {1 + 6 * i}, 6))::BIGINT)::VARCHAR" for i in range(8))
    return f"sha256(count(*)::VARCHAR || ':' || {words})"


@query("policy_digest", with_ctes(f"""
SELECT tenant_id, count(*) AS policies, 'sha256:' || {set_digest_sql()} AS digest FROM {digest_sql(_DIGEST_COLUMNS, 'policies')} GROUP BY 1""", POLICIES))
def policy_digest(spark, d):
    return p.policy_digest(t.policies(spark, d))


_AFTER = """SELECT * REPLACE (CASE WHEN policy_id LIKE '%5' THEN 'deny' ELSE action END AS action, CASE WHEN policy_id LIKE '%5' THEN revision + 1 ELSE revision END AS revision)
 FROM policies WHERE policy_id NOT LIKE '%7' UNION ALL SELECT * REPLACE ('n' || policy_id AS policy_id) FROM policies WHERE policy_id LIKE '%9'"""


def _after(spark, d):
    base = t.policies(spark, d)
    fives = F.col("policy_id").endswith("5")
    changed = base.filter(~F.col("policy_id").endswith("7")).withColumns(
        {"action": F.when(fives, "deny").otherwise(F.col("action")), "revision": F.when(fives, F.col("revision") + 1).otherwise(F.col("revision"))}
    )
    added = base.filter(F.col("policy_id").endswith("9")).withColumn("policy_id", F.concat(F.lit("n"), "policy_id"))
    return changed.unionByName(added)


@query("policy_diff", with_ctes("""
SELECT coalesce(b.tenant_id, a.tenant_id) AS tenant_id, coalesce(b.policy_id, a.policy_id) AS policy_id, CASE WHEN b.policy_id IS NULL THEN 'create' WHEN a.policy_id IS NULL THEN 'delete' ELSE 'update' END AS operation,
 CASE WHEN a.policy_id IS NULL THEN b.action = 'deny' ELSE a.action = 'allow' END AS broadens_grant, b.revision AS from_revision, a.revision AS to_revision
FROM policies b FULL JOIN after a ON a.tenant_id = b.tenant_id AND a.policy_id = b.policy_id
WHERE b.policy_id IS NULL OR a.policy_id IS NULL OR b.action <> a.action OR b.revision <> a.revision""", POLICIES, f"after AS ({_AFTER})"))
def policy_diff(spark, d):
    return p.policy_diff(t.policies(spark, d), _after(spark, d))


_PROBES = """SELECT o_orderkey AS probe_id, CASE WHEN o_custkey % 2 = 0 THEN 't0' ELSE 't1' END AS tenant_id, concat('agent-', CAST(o_custkey % 20 AS STRING)) AS agent_id,
 concat('ds-', CAST(o_orderkey % 5 AS STRING)) AS datasource_id, CASE o_orderkey % 3 WHEN 0 THEN 'sales' WHEN 1 THEN 'hr' ELSE '' END AS schema_name,
 CASE o_orderkey % 3 WHEN 0 THEN 'orders' WHEN 1 THEN 'salaries' ELSE 'events' END AS table_name FROM orders"""


def _replay_sql(source):
    return f"""SELECT p.probe_id, CASE WHEN bool_or(q.object_type <> 'table') THEN 'unknown'
  WHEN bool_or(q.action = 'deny' AND {_HIT.replace('pattern', 'q.object_name')}) THEN 'deny'
  WHEN bool_or(q.action = 'allow' AND {_HIT.replace('pattern', 'q.object_name')}) THEN 'candidate' ELSE 'deny' END AS verdict
 FROM probes p LEFT JOIN {source} q ON (q.tenant_id, q.agent_id, q.datasource_id) = (p.tenant_id, p.agent_id, p.datasource_id) GROUP BY 1"""


@query("policy_replay", with_ctes("""
SELECT probe_id, b.verdict AS before, a.verdict AS after FROM (""" + _replay_sql("policies") + ") b JOIN (" + _replay_sql("after") + ") a USING (probe_id)",
    POLICIES, f"after AS ({_AFTER})", f"probes AS ({_PROBES})"))
def policy_replay(spark, d):
    probes = t.select_over(spark, _PROBES, "orders", t.load(spark, d, "orders"))
    return p.policy_replay(t.policies(spark, d), _after(spark, d), probes)


_ROLES = "SELECT c_custkey AS role_id FROM customer"
_PARENTS = """SELECT c_custkey AS role_id, CASE WHEN c_custkey % 97 = 96 THEN CAST(1000000000 AS BIGINT) WHEN c_custkey % 101 = 100 THEN c_custkey * 3 + 1
 ELSE CAST(floor(c_custkey / 3) AS BIGINT) END AS parent_id FROM customer WHERE c_custkey > 0"""
_PERMISSIONS = "SELECT c_custkey AS role_id, concat('p', CAST(c_custkey % 50 AS STRING)) AS permission FROM customer"
_USER_ROLES = "SELECT o_orderkey AS user_id, o_custkey AS role_id FROM orders"
_CLOSED = """closed(user_id, role_id) AS (SELECT user_id, role_id FROM user_roles UNION SELECT c.user_id, p.parent_id FROM closed c JOIN parents p ON p.role_id = c.role_id),
 looped AS (SELECT DISTINCT a AS role_id FROM (WITH RECURSIVE up(a, r) AS (SELECT role_id, parent_id FROM parents UNION SELECT up.a, p.parent_id FROM up JOIN parents p ON p.role_id = up.r) SELECT * FROM up WHERE a = r)),
 bad AS (SELECT DISTINCT user_id FROM closed WHERE role_id NOT IN (SELECT role_id FROM roles) OR role_id IN (SELECT role_id FROM looped))"""


@query("effective_permissions", with_ctes("""
SELECT DISTINCT user_id, permission, false AS forbidden FROM closed JOIN permissions USING (role_id) WHERE user_id NOT IN (SELECT user_id FROM bad)
UNION ALL SELECT user_id, NULL, true FROM bad""", f"RECURSIVE roles AS ({_ROLES})", f"parents AS ({_PARENTS})", f"permissions AS ({_PERMISSIONS})", f"user_roles AS ({_USER_ROLES})", _CLOSED))
def effective_permissions(spark, d):
    customer = t.load(spark, d, "customer")
    return p.effective_permissions(
        t.select_over(spark, _ROLES, "customer", customer),
        t.select_over(spark, _PARENTS, "customer", customer),
        t.select_over(spark, _PERMISSIONS, "customer", customer),
        t.select_over(spark, _USER_ROLES, "orders", t.load(spark, d, "orders")),
    )


_REQUESTED = "SELECT o_custkey AS user_id, concat('p', CAST(o_orderkey % 7 AS STRING)) AS permission FROM orders"
_HELD = "SELECT c_custkey AS user_id, concat('p', CAST(c_custkey % 7 AS STRING)) AS permission FROM customer"


@query("delegation_violations", with_ctes("""
SELECT user_id, permission FROM requested r WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.user_id = r.user_id AND h.permission = r.permission)""",
    f"requested AS ({_REQUESTED})", f"held AS ({_HELD})"))
def delegation_violations(spark, d):
    return p.delegation_violations(
        t.select_over(spark, _REQUESTED, "orders", t.load(spark, d, "orders")),
        t.select_over(spark, _HELD, "customer", t.load(spark, d, "customer")),
    )


_KEYS = """SELECT o_orderkey AS key_id, concat('agent-', CAST(o_custkey % 5 AS STRING)) AS agent_id, o_custkey % 2 AS db,
 CASE o_orderkey % 4 WHEN 0 THEN concat('order:', CAST(o_orderkey AS STRING)) WHEN 1 THEN concat('cart:', CAST(o_custkey AS STRING), ':items')
  WHEN 2 THEN concat('sess:', CAST(o_orderkey AS STRING)) ELSE 'x*' END AS key FROM orders"""
_SCOPES = """SELECT concat('agent-', CAST(s_suppkey % 5 AS STRING)) AS agent_id, concat('db', CAST(s_suppkey % 2 AS STRING), ':',
  CASE s_suppkey % 4 WHEN 0 THEN concat('order:', CAST(s_suppkey AS STRING), '*') WHEN 1 THEN 'cart:*' WHEN 2 THEN concat('sess:', CAST(s_suppkey AS STRING)) ELSE concat('order:', CAST(s_suppkey AS STRING)) END) AS scope,
 CASE WHEN s_suppkey % 9 = 8 THEN 'deny' ELSE 'allow' END AS action FROM supplier"""


@query("key_access", with_ctes(r"""
SELECT key_id, coalesce(regexp_full_match(any_value(key), '[A-Za-z0-9][A-Za-z0-9:_-]{2,126}') AND bool_or(action = 'allow') AND NOT bool_or(action = 'deny'), false) AS granted
FROM keys k LEFT JOIN scopes s ON s.agent_id = k.agent_id AND CASE WHEN s.scope LIKE '%*' THEN starts_with('db' || db || ':' || key, rtrim(s.scope, '*')) ELSE s.scope = 'db' || db || ':' || key END GROUP BY 1""",
    f"keys AS ({_KEYS})", f"scopes AS ({_SCOPES})"))
def key_access(spark, d):
    return p.key_access(
        t.select_over(spark, _KEYS, "orders", t.load(spark, d, "orders")), t.select_over(spark, _SCOPES, "supplier", t.load(spark, d, "supplier"))
    )


_FIELDS = """SELECT key_id, agent_id, db, key, CASE WHEN key_id % 3 = 0 THEN 'name' WHEN key_id % 3 = 1 THEN 'total' ELSE '9bad' END AS field FROM keys"""
_FIELD_GRANTS = "SELECT agent_id, scope AS key_scope, 'name' AS field FROM scopes"


@query("hash_field_access", with_ctes(r"""
SELECT f.key_id, f.field FROM fields f WHERE f.field = 'name'
 AND EXISTS (SELECT 1 FROM scopes s WHERE s.agent_id = f.agent_id AND s.action = 'allow' AND s.scope = 'db' || db || ':' || key)
 AND NOT EXISTS (SELECT 1 FROM scopes s WHERE s.agent_id = f.agent_id AND s.action = 'deny' AND CASE WHEN s.scope LIKE '%*' THEN starts_with('db' || db || ':' || key, rtrim(s.scope, '*')) ELSE s.scope = 'db' || db || ':' || key END)""",
    f"keys AS ({_KEYS})", f"scopes AS ({_SCOPES})", f"fields AS ({_FIELDS})"))
def hash_field_access(spark, d):
    keys = t.select_over(spark, _KEYS, "orders", t.load(spark, d, "orders"))
    scopes = t.select_over(spark, _SCOPES, "supplier", t.load(spark, d, "supplier"))
    return p.hash_field_access(t.select_over(spark, _FIELDS, "keys", keys), scopes, t.select_over(spark, _FIELD_GRANTS, "scopes", scopes))


_TASK_GRANTS = """SELECT o_orderkey AS grant_id, concat('t', CAST(o_custkey % 2 AS STRING)) AS tenant_id, o_custkey AS issuer_id, concat('agent-', CAST(o_custkey % 25 AS STRING)) AS agent_id,
 concat('ds-', CAST(o_orderkey % 5 AS STRING)) AS datasource_id, o_orderdate + INTERVAL 400 DAY AS expires_at, CASE WHEN o_orderkey % 11 = 0 THEN o_orderdate END AS revoked_at,
 CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderkey % 3 AS INT) END AS max_uses, CAST(o_custkey % 3 AS INT) AS used_count FROM orders"""
_GRANT_AGENTS = f"SELECT tenant_id, agent_id, status, CAST(NULL AS TIMESTAMP) AS expires_at FROM ({t.AGENTS_SQL}) AS agent_rows"
_GRANT_USERS = "SELECT concat('t', CAST(c_custkey % 2 AS STRING)) AS tenant_id, c_custkey AS issuer_id, CASE WHEN c_nationkey = 3 THEN 'locked' ELSE 'active' END AS status FROM customer"


@query("valid_grants", with_ctes("""
SELECT grant_id FROM task_grants g WHERE revoked_at IS NULL AND expires_at > TIMESTAMP '1999-06-01' AND (max_uses IS NULL OR used_count < max_uses)
 AND EXISTS (SELECT 1 FROM grant_agents a WHERE a.tenant_id = g.tenant_id AND a.agent_id = g.agent_id AND a.status = 'active')
 AND EXISTS (SELECT 1 FROM grant_users u WHERE u.tenant_id = g.tenant_id AND u.issuer_id = g.issuer_id AND u.status = 'active')""",
    f"task_grants AS ({_TASK_GRANTS})", f"grant_agents AS ({_GRANT_AGENTS})", f"grant_users AS ({_GRANT_USERS})"))
def valid_grants(spark, d):
    agents = t.agents(spark, d).withColumn("expires_at", F.lit(None).cast("timestamp_ntz"))
    return p.valid_grants(
        t.select_over(spark, _TASK_GRANTS, "orders", t.load(spark, d, "orders")),
        agents,
        t.select_over(spark, _GRANT_USERS, "customer", t.load(spark, d, "customer")),
        t.agents(spark, d).select("tenant_id").distinct().withColumn("status", F.lit("active")),
        dt.datetime(1999, 6, 1),
    ).select("grant_id")


@query("grant_usage", over_audit("""
SELECT id, session_id AS grant_id, row_number() OVER (PARTITION BY session_id ORDER BY ts, id) AS use_no,
 row_number() OVER (PARTITION BY session_id ORDER BY ts, id) <= 5 + CAST(substr(session_id, 3) AS INT) % 50 AS granted FROM audit_log"""))
def grant_usage(spark, d):
    log = t.audit_log(spark, d).withColumn("grant_id", F.col("session_id")).select("id", "ts", "grant_id")
    grants = log.select("grant_id").distinct().withColumn("max_uses", 5 + F.substr("grant_id", F.lit(3)).cast("int") % 50)
    return p.grant_usage(log, grants).select("id", "grant_id", "use_no", "granted")


_BOUND = "SELECT policy_id, object_type, concat('b', policy_id) AS relation_binding_id FROM policies"
_BINDING_ROWS = """SELECT concat('b', policy_id) AS binding_id, policy_id, CASE WHEN revision % 3 = 0 THEN NULL ELSE 'oid' END AS stable_object_id, 'fp' AS catalog_fingerprint,
 CASE WHEN revision % 5 = 0 THEN 'stale' ELSE 'healthy' END AS status FROM policies WHERE object_type = 'column'"""
_STAGED = "SELECT policy_id FROM policies WHERE object_type = 'column' AND revision % 7 = 0"
_HELD_GRANTS = "SELECT policy_id, concat('b', policy_id) AS binding_id FROM policies"


@query("policy_health", with_ctes("""
SELECT 'staged_rows' AS finding, count(*) AS n FROM policies WHERE object_type = 'column' AND revision % 7 = 0
UNION ALL SELECT 'incomplete_bindings', count(*) FROM policies WHERE object_type = 'column' AND revision % 3 = 0
UNION ALL SELECT 'unhealthy_bindings', count(*) FROM policies WHERE object_type = 'column' AND revision % 5 = 0
UNION ALL SELECT 'orphaned_grants', count(*) FROM policies WHERE object_type <> 'column' OR revision % 5 = 0""", POLICIES))
def policy_health(spark, d):
    policies = t.policies(spark, d)
    over = lambda text: t.select_over(spark, text, "policies", policies)
    return p.policy_health(over(_BOUND), over(_STAGED), over(_BINDING_ROWS), over(_HELD_GRANTS))


_MAP = """SELECT policy_id, CASE WHEN revision % 13 = 0 THEN NULL WHEN revision % 17 = 0 THEN 'same' ELSE CASE WHEN revision % 2 = 0 THEN policy_id ELSE concat('new-', policy_id) END END AS target_id,
 CASE WHEN revision % 19 = 0 THEN 'a.*' ELSE concat('prod.', 't', CAST(revision AS STRING)) END AS target_object FROM policies"""


def _promotion(spark, d):
    policies = t.policies(spark, d)
    agents = t.agents(spark, d).select("agent_id", F.concat(F.lit("prod-"), "agent_id").alias("target_agent"))
    sources = t.datasources(spark, d).select("datasource_id", F.concat(F.lit("prod-"), "datasource_id").alias("target_datasource"))
    return p.promote_policies(policies, t.select_over(spark, _MAP, "policies", policies), agents, sources, policies)


@query("promote_policies", with_ctes("""
SELECT p.policy_id AS source_id, m.target_id AS policy_id, 'prod-' || agent_id AS agent_id, 'prod-' || datasource_id AS datasource_id, target_object AS object_name, object_type, action,
 CASE WHEN revision % 2 = 0 THEN revision ELSE 0 END AS revision, CASE WHEN revision % 2 = 0 THEN 'replace' ELSE 'create' END AS operation
FROM policies p JOIN map m USING (policy_id) WHERE revision % 13 <> 0 AND revision % 17 <> 0 AND revision % 19 <> 0""", POLICIES, f"map AS ({_MAP})"))
def promote_policies(spark, d):
    return _promotion(spark, d)[0]


@query("promotion_problems", with_ctes("""
SELECT policy_id, CASE WHEN revision % 13 = 0 THEN 'incomplete_mapping' WHEN revision % 19 = 0 THEN 'invalid_object' ELSE 'target_not_unique' END AS problem
FROM policies p WHERE revision % 13 = 0 OR revision % 19 = 0 OR (revision % 17 = 0 AND (SELECT count(*) FROM policies WHERE revision % 17 = 0 AND revision % 13 <> 0 AND revision % 19 <> 0) > 1)""", POLICIES))
def promotion_problems(spark, d):
    return _promotion(spark, d)[1]


_SCOPED = """SELECT column_id AS rule_id, CASE WHEN ordinal % 2 = 0 THEN ' ds-1 ' ELSE CAST(NULL AS STRING) END AS datasource_id, concat(' ', column_name) AS column_name FROM names"""


@query("duplicate_rules", with_ctes("""
SELECT scope_key, column_key, rule_id, n, first_id FROM (SELECT *, count(*) OVER w AS n, min(rule_id) OVER w AS first_id FROM (
 SELECT rule_id, coalesce(trim(datasource_id), '') AS scope_key, lower(trim(column_name)) AS column_key FROM scoped) WINDOW w AS (PARTITION BY scope_key, column_key)) WHERE n > 1""",
    f"names AS ({t.COLUMNS_SQL})", f"scoped AS ({_SCOPED})"))
def duplicate_rules(spark, d):
    return p.duplicate_rules(t.select_over(spark, _SCOPED, "names", t.column_names(spark, d)))
