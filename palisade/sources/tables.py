"""The given Parquet tables and the views derived from them.

`audit_log` and `contact` hold the same text for Spark SQL and for other SQL engines, so a
check can run the identical derivation on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

AUDIT_LOG_COLUMNS = """
 event_id AS id, CASE WHEN user_id % 2 = 0 THEN 't0' ELSE 't1' END AS tenant_id, ts,
 concat('agent-', CAST(user_id % 20 AS STRING)) AS agent_id,
 concat('ds-', CAST(user_id % 5 AS STRING)) AS datasource_id,
 concat('s-', CAST(user_id AS STRING)) AS session_id,
 CASE event_type WHEN 'view' THEN 'SELECT' WHEN 'click' THEN 'SELECT' WHEN 'purchase' THEN 'INSERT'
                 WHEN 'signup' THEN 'UPDATE' ELSE 'DELETE' END AS stmt_type,
 CASE WHEN event_type = 'error' AND k % 2 = 0 THEN 'deny' WHEN event_type = 'error' THEN 'error'
      WHEN event_type = 'purchase' THEN 'approve' WHEN event_type = 'signup' THEN 'warn' ELSE 'allow' END AS decision,
 CASE WHEN event_type = 'error' AND k % 2 = 0
      THEN concat('[{"RuleID":"R', CASE WHEN k % 4 = 0 THEN '002' ELSE '010' END, '","Decision":"deny"}]')
      WHEN event_type = 'signup' THEN '[{"RuleID":"R005","Decision":"warn"}]'
      WHEN event_type = 'purchase'
      THEN '[{"RuleID":"R004","Decision":"approve"},{"RuleID":"R009","Decision":"approve"}]' END AS rule_hits,
 CAST(floor(value * 100) AS BIGINT) AS est_rows, CAST(floor(value) AS BIGINT) AS latency_ms,
 CASE WHEN event_type = 'error' AND k % 2 = 1
      THEN CASE WHEN k % 3 = 0 THEN 'DB_QUERY_TIMEOUT' ELSE 'DB_SYNTAX_ERROR' END END AS error_code,
 md5(CAST(event_id AS STRING)) AS event_uuid, k
"""
AUDIT_LOG_SQL = (
    f"SELECT {AUDIT_LOG_COLUMNS} FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)"
)

CONTACT_COLUMNS = """
 c_custkey, c_nationkey, c_mktsegment, c_acctbal,
 concat('138', lpad(CAST(c_custkey AS STRING), 8, '0')) AS phone,
 concat('user', CAST(c_custkey AS STRING), '@example.test') AS email,
 concat('10.', CAST(c_custkey % 256 AS STRING), '.', CAST(c_nationkey AS STRING), '.7') AS client_ip,
 concat('4', lpad(CAST(c_custkey * 7919 AS STRING), 15, '0')) AS card_no
"""
CONTACT_SQL = f"SELECT {CONTACT_COLUMNS} FROM customer"

# A logged statement's signals: what a parser would have reported for it.
SIGNAL_COLUMNS = """
 id, tenant_id, ts, agent_id, datasource_id, stmt_type,
 CASE WHEN id % 2 = 0 THEN 'postgres' ELSE 'mysql' END AS dialect,
 k % 19 = 0 AS is_multi, k % 5 <> 0 AS has_where, k % 23 = 0 AS where_tautology, k % 3 = 0 AS has_limit,
 k % 7 = 0 AS has_group_by, k % 11 = 0 AS is_pure_aggregate,
 CASE WHEN k % 13 <> 0 THEN est_rows * 10 END AS est_scan_rows, k % 29 = 0 AS truncated,
 CASE WHEN k % 4 = 0 THEN 'sales.orders' WHEN k % 4 = 1 THEN 'sales.lineitem' WHEN k % 4 = 2 THEN 'hr.salaries' ELSE 'events' END AS table_1,
 CASE WHEN k % 6 = 0 THEN 'sales.customer' END AS table_2,
 CASE WHEN k % 17 = 0 THEN 'pg_catalog.pg_read_file' WHEN k % 16 = 0 THEN 'sleep' WHEN k % 15 = 0 THEN 'pg_sleep' WHEN k % 2 = 0 THEN 'lower' END AS function_1,
 CASE WHEN k % 31 = 0 THEN 'DROP TABLE' WHEN k % 30 = 0 THEN 'SQL_COMMENT' WHEN k % 28 = 0 THEN 'REINDEX' WHEN k % 27 = 0 THEN 'COPY PROGRAM'
      WHEN k % 26 = 0 THEN 'ALTER TABLE' WHEN k % 25 = 0 THEN 'LOAD_FILE' WHEN k % 24 = 0 THEN 'SET GLOBAL'
      WHEN k % 9 = 0 THEN concat('NESTING_DEPTH:', CAST(k AS STRING)) WHEN k % 8 = 0 THEN concat('UNION_COUNT:', CAST(k AS STRING)) ELSE 'SCAN' END AS operation_1,
 concat('SELECT_COLUMN:', CASE WHEN k % 10 = 0 THEN '*' WHEN k % 10 < 5 THEN 'o_orderkey' ELSE 'o_totalprice' END) AS operation_2,
 latency_ms * 100 AS tx_age_ms, latency_ms * 60 AS tx_idle_ms, est_rows AS tx_affected_rows, k % 3 <> 1 AS in_transaction, k, latency_ms
"""
SIGNALS_SQL = f"SELECT {SIGNAL_COLUMNS} FROM audit_log"

# Dimension views: agents from nations, data sources from regions, approvals and outbox from the log.
AGENTS_SQL = """SELECT CASE WHEN n_nationkey % 2 = 0 THEN 't0' ELSE 't1' END AS tenant_id,
 concat('agent-', CAST(n_nationkey AS STRING)) AS agent_id, n_name AS name,
 CASE WHEN n_regionkey = 0 THEN 'disabled' ELSE 'active' END AS status,
 CASE WHEN n_nationkey % 3 = 0 THEN 'readonly' WHEN n_nationkey % 3 = 1 THEN 'dml' ELSE 'ddl' END AS level
 FROM nation"""
DATASOURCES_SQL = """SELECT CASE WHEN r_regionkey % 2 = 0 THEN 't0' ELSE 't1' END AS tenant_id,
 concat('ds-', CAST(r_regionkey AS STRING)) AS datasource_id, r_name AS name FROM region"""
APPROVALS_SQL = """SELECT id, tenant_id, agent_id, ts AS created_at,
 CASE k % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' WHEN 2 THEN 'rejected' ELSE 'expired' END AS status
 FROM audit_log WHERE decision = 'approve'"""
OUTBOX_SQL = """SELECT event_uuid, tenant_id, ts AS created_at, k % 3 AS attempts,
 CASE WHEN k % 10 < 9 THEN ts END AS delivered_at, concat('policy.', lower(stmt_type)) AS action,
 'user' AS actor_type, agent_id AS actor_id,
 CASE WHEN k % 11 = 0 THEN '{"db": {"password": "x"}}' WHEN k % 12 = 0 THEN '{broken' WHEN k % 13 = 0 THEN '{"audit_phase":"intent"}'
      WHEN k % 14 = 0 THEN '{"to": "postgres://h/db"}' ELSE concat('{"grant_id":"g', CAST(k AS STRING), '"}') END AS details_json
 FROM audit_log WHERE decision IN ('approve', 'deny')"""
SQL_TEXT_SQL = """SELECT id, ts, agent_id, tenant_id, decision,
 concat('SELECT  a FROM ', CASE WHEN k % 2 = 0 THEN 'orders' ELSE 'part' END, ' WHERE id = ', CAST(id AS STRING),
        CASE WHEN k % 3 = 0 THEN concat(' AND name = ', chr(39), 'n', CAST(k AS STRING), chr(39)) ELSE '' END) AS sql_raw,
 CASE WHEN k % 9 = 0 THEN 'Connection refused by peer' WHEN k % 8 = 0 THEN 'context DEADLINE exceeded'
      WHEN k % 7 = 0 THEN 'odd failure' END AS error_msg, error_code
 FROM audit_log"""


def select_over(spark: SparkSession, text: str, name: str, df: DataFrame) -> DataFrame:
    """Run SQL text with `FROM name` bound to a DataFrame; braces in the text stay literal."""
    escaped = text.replace("{", "{{").replace("}", "}}").replace(f"FROM {name}", "FROM {source}")
    return spark.sql(escaped, source=df)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))
    return select_over(spark, f"SELECT {AUDIT_LOG_COLUMNS} FROM events", "events", events)


def contact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_over(spark, CONTACT_SQL, "customer", load(spark, sf_dir, "customer"))


def query_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signal log with its lists as arrays; NULL entries are dropped from them."""
    flat = from_audit(spark, sf_dir, SIGNALS_SQL)
    return flat.withColumns(
        {
            "tables": F.array_compact(F.array("table_1", "table_2")),
            "functions": F.array_compact(F.array("function_1")),
            "operations": F.array_compact(F.array("operation_1", "operation_2")),
        }
    ).drop("table_1", "table_2", "function_1", "operation_1", "operation_2")


def table_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per column of every given table, from the Parquet schemas."""
    rows = [
        ("main", name, field.name, field.dataType.simpleString(), ordinal)
        for name in TABLES
        for ordinal, field in enumerate(load(spark, sf_dir, name).schema.fields, start=1)
    ]
    return spark.createDataFrame(rows, "schema_name string, table_name string, column_name string, data_type string, ordinal int")


def agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_over(spark, AGENTS_SQL, "nation", load(spark, sf_dir, "nation"))


def datasources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_over(spark, DATASOURCES_SQL, "region", load(spark, sf_dir, "region"))


def from_audit(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run one of the audit-derived view texts over the audit log."""
    return select_over(spark, text, "audit_log", audit_log(spark, sf_dir))


# Cells with identity numbers, dates and amounts as text; every shape a mask has to meet.
CELLS_SQL = """SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN 'unknown'
  WHEN c_custkey % 7 = 0 THEN concat('110105', lpad(CAST(c_custkey % 100 AS STRING), 2, '0'), '0812', lpad(CAST(c_custkey % 1000 AS STRING), 3, '0'))
  ELSE concat('110105', CAST(1950 + c_custkey % 60 AS STRING), lpad(CAST(1 + c_custkey % 12 AS STRING), 2, '0'),
   lpad(CAST(1 + c_custkey % 30 AS STRING), 2, '0'), lpad(CAST(c_custkey % 1000 AS STRING), 3, '0'),
   CASE c_custkey % 11 WHEN 10 THEN 'x' ELSE CAST(c_custkey % 11 AS STRING) END) END AS id_text,
 CASE c_custkey % 6 WHEN 0 THEN 'n/a' WHEN 1 THEN concat(CAST(1900 + c_custkey % 130 AS STRING), '-02-29')
  WHEN 2 THEN concat(CAST(1900 + c_custkey % 130 AS STRING), '/06/15') WHEN 3 THEN concat(CAST(1900 + c_custkey % 130 AS STRING), '0704')
  WHEN 4 THEN concat(CAST(1900 + c_custkey % 130 AS STRING), '-11-05 08:30:00') ELSE '' END AS born,
 CASE WHEN c_custkey % 10 = 0 THEN 'none' ELSE CAST(c_acctbal AS STRING) END AS amount,
 CASE WHEN c_custkey % 9 = 0 THEN 'NULL' ELSE concat('138', lpad(CAST(c_custkey AS STRING), 8, '0')) END AS phone,
 CASE c_custkey % 5 WHEN 0 THEN concat('2001:db8:', CAST(c_custkey % 10 AS STRING), '::1')
  WHEN 1 THEN concat('10.', CAST(c_custkey % 256 AS STRING), '.0.7/24') WHEN 2 THEN concat('300.1.1.', CAST(c_custkey % 10 AS STRING))
  WHEN 3 THEN concat('::ffff:10.', CAST(c_custkey % 256 AS STRING), '.9.9') ELSE concat('192.168.', CAST(c_custkey % 256 AS STRING), '.1') END AS ip_text
 FROM customer"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_over(spark, CELLS_SQL, "customer", load(spark, sf_dir, "customer"))


# A catalog of column names made from the part table: schema, table, name, ordinal and comment.
COLUMNS_SQL = """SELECT p_partkey AS column_id, concat('s', CAST(p_size % 3 AS STRING)) AS schema_name,
 concat('t', CAST(p_partkey % 40 AS STRING)) AS table_name, CAST(p_partkey AS INT) AS ordinal,
 concat(CASE p_partkey % 5 WHEN 0 THEN 'cust_' WHEN 1 THEN 'home' WHEN 2 THEN '' WHEN 3 THEN 'user2' ELSE 'BILLING_' END,
  CASE p_size % 17 WHEN 0 THEN 'PhoneNumber' WHEN 1 THEN 'email_address' WHEN 2 THEN 'id_card' WHEN 3 THEN 'cardNo' WHEN 4 THEN 'clientIP'
   WHEN 5 THEN 'BirthDate' WHEN 6 THEN 'created_at' WHEN 7 THEN 'TotalAmount' WHEN 8 THEN 'FullName' WHEN 9 THEN 'remark' WHEN 10 THEN 'Mobile'
   WHEN 11 THEN 'tel' WHEN 12 THEN 'status' WHEN 13 THEN 'IPAddress' WHEN 14 THEN 'price_date' WHEN 15 THEN 'name_email' ELSE 'code' END) AS column_name,
 p_type AS comment FROM part"""


def column_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_over(spark, COLUMNS_SQL, "part", load(spark, sf_dir, "part"))


# Result columns of logged queries with their sources, seven per query, one per order.
RESULT_COLUMNS_SQL = """SELECT CAST(floor(o_orderkey / 7) AS BIGINT) AS query_id, CAST(o_orderkey % 7 AS INT) AS output_index,
 CASE p % 6 WHEN 0 THEN 'phone' WHEN 1 THEN '"Email"' WHEN 2 THEN 'total' WHEN 3 THEN 'card_no' WHEN 4 THEN 'mobile' ELSE 'note' END AS result_name,
 CASE WHEN o_custkey % 4 = 0 THEN 'crm' WHEN o_custkey % 4 = 1 THEN 'shop' ELSE '' END AS source_schema,
 CASE WHEN o_custkey % 5 < 3 THEN concat('t', CAST(o_custkey % 3 AS STRING)) ELSE '' END AS source_table,
 CASE WHEN p % 7 = 0 THEN '' ELSE CASE p % 4 WHEN 0 THEN 'phone' WHEN 1 THEN 'email' WHEN 2 THEN 'card_no' ELSE 'note' END END AS source_column,
 CASE WHEN o_custkey % 2 = 0 THEN 'crm' ELSE 'hr' END AS possible_schema,
 concat('t', CAST(o_custkey % 4 AS STRING)) AS possible_table
 FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS p FROM orders) AS priced"""

# Mask rules as a small fixed dimension; '' in schema or table means "any".
RULES_SQL = """SELECT * FROM (VALUES
 ('r1', '', '', 'phone', 'phone', 'mask'), ('r2', '', '', 'email', 'email', 'hash'),
 ('r3', 'crm', 't0', 'phone', 'phone', 'block'), ('r4', '', 't1', 'email', 'email', 'mask'),
 ('r5', 'crm', 't2', 'card_no', 'bankcard', 'mask'), ('r6', '', 't0', 'note', 'generic', 'block'),
 ('r7', '', 't3', 'total', 'number', 'range'), ('r8', 'hr', 't2', 'phone', 'idcard', 'mask'))
 AS v(rule_id, schema_name, table_name, column_name, sensitive_type, algorithm)"""


def result_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = select_over(spark, RESULT_COLUMNS_SQL, "orders", load(spark, sf_dir, "orders"))
    relation = F.struct(F.col("possible_schema").alias("schema_name"), F.col("possible_table").alias("table_name"))
    return flat.withColumn("possible_relations", F.array(relation)).drop("possible_schema", "possible_table")


def mask_rules(spark: SparkSession) -> DataFrame:
    return spark.sql(RULES_SQL)


# Lineage of logged outputs: one row per dependency of an output's arm, six orders making one query.
LINEAGE_SQL = """SELECT query_id, slot % 3 AS output_index, CAST(floor(slot / 3) AS INT) AS arm_index, d AS dep_index,
 CASE (query_id + slot % 3) % 9 WHEN 0 THEN 'phone' WHEN 1 THEN 'email' WHEN 2 THEN 'total' ELSE 'x' END AS result_name,
 CASE q % 10 WHEN 7 THEN 'transparent' WHEN 8 THEN 'aggregate' WHEN 9 THEN 'constant' WHEN 6 THEN 'opaque' WHEN 5 THEN 'composite' ELSE 'direct' END AS kind,
 CASE WHEN q % 10 = 8 THEN 'aggregate:count' WHEN q % 20 = 7 THEN 'concat_empty' WHEN q % 10 = 7 THEN 'coalesce_null' ELSE '' END AS operation,
 CASE WHEN q % 10 IN (8, 9) THEN 'source_free' WHEN q % 17 = 0 THEN 'unresolved' ELSE 'resolved' END AS status,
 CASE WHEN has_dep THEN CASE q % 4 WHEN 0 THEN 'crm' ELSE '' END END AS dep_schema,
 CASE WHEN has_dep THEN concat('t', CAST(q % 5 AS STRING)) END AS dep_table,
 CASE WHEN has_dep THEN CASE (query_id + d) % 6 WHEN 0 THEN 'phone' WHEN 1 THEN 'email' WHEN 2 THEN 'card_no' WHEN 3 THEN 'total' ELSE 'x' END END AS dep_column,
 CASE WHEN has_dep THEN CASE WHEN q % 19 = 0 THEN 'filter' ELSE 'value' END END AS dep_role,
 CASE WHEN q % 3 = 0 THEN 'crm' ELSE 'hr' END AS possible_schema, concat('t', CAST(q % 6 AS STRING)) AS possible_table
 FROM (SELECT *, q % 10 NOT IN (6, 8, 9) AS has_dep FROM dependencies) AS numbered"""
DEPENDENCIES_SQL = """SELECT CAST(floor(o_orderkey / 6) AS BIGINT) AS query_id, CAST(o_orderkey % 6 AS INT) AS slot,
 CAST(CAST(floor(o_totalprice) AS BIGINT) % 60 AS INT) AS q, d FROM (
 SELECT *, 0 AS d FROM orders UNION ALL SELECT *, 1 AS d FROM orders WHERE CAST(floor(o_totalprice) AS BIGINT) % 15 = 4) AS both_rows"""


def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = select_over(spark, DEPENDENCIES_SQL, "orders", load(spark, sf_dir, "orders"))
    flat = select_over(spark, LINEAGE_SQL, "dependencies", rows)
    relation = F.struct(F.col("possible_schema").alias("schema_name"), F.col("possible_table").alias("table_name"))
    return flat.withColumn("possible_relations", F.array(relation)).drop("possible_schema", "possible_table")


# Policies made from parts: patterns of every level, some denies, some column grants.
POLICIES_SQL = """SELECT lpad(CAST(p_partkey AS STRING), 8, '0') AS policy_id, CASE WHEN p_partkey % 2 = 0 THEN 't0' ELSE 't1' END AS tenant_id,
 concat('agent-', CAST(p_partkey % 20 AS STRING)) AS agent_id, concat('ds-', CAST(p_size % 5 AS STRING)) AS datasource_id,
 CASE WHEN p_partkey % 7 = 3 THEN 'column' ELSE 'table' END AS object_type,
 CASE WHEN p_partkey % 7 = 3 THEN CASE p_size % 2 WHEN 0 THEN 'sales.orders' ELSE 'sales.lineitem' END
  ELSE CASE p_size % 11 WHEN 0 THEN '*' WHEN 1 THEN 'sales.*' WHEN 2 THEN 'hr.salaries' WHEN 3 THEN 'events' WHEN 4 THEN 'sales.orders'
   WHEN 5 THEN 'sales.lineitem' WHEN 6 THEN 'sales.customer' ELSE concat('x.t', CAST(p_size AS STRING)) END END AS object_name,
 CASE WHEN p_partkey % 7 = 3 THEN CASE p_size % 3 WHEN 0 THEN 'o_orderkey, o_custkey' WHEN 1 THEN 'o_orderkey' ELSE 'o_totalprice,l_tax' END END AS columns,
 CAST(NULL AS STRING) AS row_filter,
 CASE WHEN p_partkey % 7 <> 3 AND p_partkey % 31 = 0 THEN 'deny' ELSE 'allow' END AS action, CAST(p_size AS INT) AS revision FROM part"""


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_over(spark, POLICIES_SQL, "part", load(spark, sf_dir, "part"))
