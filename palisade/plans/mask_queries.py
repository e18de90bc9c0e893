"""Masking queries over contacts, text cells and logged result columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.functions import masks as m
from palisade.operators import redact as r
from palisade.plans.registry import CHECK_SQL, over_contact, query, with_ctes
from palisade.session import scratch_path
from palisade.sources import tables as t

CELLS = f"cells AS ({t.CELLS_SQL})"
RULES = f"rules AS ({t.RULES_SQL})"
KEY = m.HashKey(2, b"palisade-trial-key-material-0000")


def _pads() -> tuple[str, str, str]:
    key = KEY.material.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex(), KEY.domain.hex()


def fingerprint_sql(column: str) -> str:
    inner, outer, domain = _pads()
    return (
        f"'h.2.' || substr(sha256(from_hex('{outer}') || from_hex(sha256(from_hex('{inner}') || from_hex('{domain}')"
        f" || encode({column})))), 1, 32)"
    )


@query("mask_phone", with_ctes("""
SELECT c_custkey, CASE WHEN phone = 'NULL' THEN phone ELSE substr(phone, 1, 3) || '****' || right(phone, 4) END AS phone FROM cells""", CELLS))
def mask_phone(spark, d):
    return t.cells(spark, d).select("c_custkey", m.mask_phone("phone").alias("phone"))


@query("mask_email", over_contact("""
SELECT c_custkey, substr(email, 1, 1) || '***@' || split_part(email, '@', 2) AS email FROM contact"""))
def mask_email(spark, d):
    return t.contact(spark, d).select("c_custkey", m.mask_email("email").alias("email"))


@query("mask_idcard", with_ctes("""
SELECT c_custkey, CASE WHEN regexp_full_match(id_text, '[0-9]{17}[0-9Xx]') THEN substr(id_text, 1, 6) || '********' || upper(right(id_text, 4))
 WHEN regexp_full_match(id_text, '[0-9]{15}') THEN substr(id_text, 1, 6) || '******' || right(id_text, 3) ELSE '[REDACTED]' END AS id_text
FROM cells""", CELLS))
def mask_idcard(spark, d):
    return t.cells(spark, d).select("c_custkey", m.mask_idcard("id_text").alias("id_text"))


@query("mask_bankcard", over_contact("""
SELECT c_custkey, substr(card_no, 1, 6) || repeat('*', length(card_no) - 10) || right(card_no, 4) AS card_no FROM contact"""))
def mask_bankcard(spark, d):
    return t.contact(spark, d).select("c_custkey", m.mask_bankcard("card_no").alias("card_no"))


@query("mask_ip", with_ctes("""
SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '2001:0db8:****' WHEN 1 THEN '10.' || (c_custkey % 256) || '.*.*'
 WHEN 2 THEN '[REDACTED]' WHEN 3 THEN '10.' || (c_custkey % 256) || '.*.*' ELSE '192.168.*.*' END AS ip_text FROM cells""", CELLS))
def mask_ip(spark, d):
    return t.cells(spark, d).select("c_custkey", m.mask_ip("ip_text").alias("ip_text"))


_LEAP = "(1900 + c_custkey % 130) % 4 = 0 AND ((1900 + c_custkey % 130) % 100 <> 0 OR (1900 + c_custkey % 130) % 400 = 0)"


@query("mask_birthdate", with_ctes(f"""
SELECT c_custkey, CASE WHEN born = '' THEN '' WHEN born = 'n/a' OR (born LIKE '%-02-29' AND NOT ({_LEAP})) THEN '[REDACTED]'
 ELSE substr(born, 1, 4) || '-**-**' END AS born FROM cells""", CELLS))
def mask_birthdate(spark, d):
    return t.cells(spark, d).select("c_custkey", m.mask_birthdate("born").alias("born"))


@query("fingerprint", over_contact(f"SELECT c_custkey, {fingerprint_sql('email')} AS email FROM contact"))
def fingerprint(spark, d):
    return t.contact(spark, d).select("c_custkey", m.fingerprint("email", KEY).alias("email"))


@query("fingerprint_join", with_ctes(f"""
SELECT {fingerprint_sql('c_name')} AS c_name, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1""", "one AS (SELECT 1)"))
def fingerprint_join(spark, d):
    """Both sides fingerprinted first: equal values still meet under the mask."""
    customers = t.load(spark, d, "customer").select(
        m.fingerprint(F.col("c_custkey").cast("string"), KEY).alias("key"), m.fingerprint("c_name", KEY).alias("c_name")
    )
    orders = t.load(spark, d, "orders").select(m.fingerprint(F.col("o_custkey").cast("string"), KEY).alias("key"), "o_totalprice")
    return customers.join(orders, "key").groupBy("c_name").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


_MIXED = """mixed AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN concat('h.', md5(email))
 WHEN c_custkey % 4 = 1 THEN concat('h.', CAST(2 + c_custkey % 3 AS STRING), '.', md5(email)) WHEN c_custkey % 4 = 2 THEN email ELSE '' END AS cell FROM contact)"""


@query("fingerprint_versions", over_contact("""
SELECT CASE c_custkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 + c_custkey % 3 ELSE 0 END::INT AS version, count(*) AS n
FROM mixed WHERE cell <> '' GROUP BY 1""", _MIXED))
def fingerprint_versions(spark, d):
    body = _MIXED[_MIXED.index("(") + 1 : -1]
    return r.fingerprint_versions(t.select_over(spark, body, "contact", t.contact(spark, d)), "cell")


@query("fingerprint_verify", over_contact("""
SELECT count(*) FILTER (c_custkey % 10 <> 0) AS verified, count(*) FILTER (c_custkey % 10 = 0) AS mismatched FROM contact"""))
def fingerprint_verify(spark, d):
    stored = F.when(F.col("c_custkey") % 10 == 0, m.fingerprint("phone", KEY)).otherwise(m.fingerprint("email", KEY))
    return r.verify_fingerprints(t.contact(spark, d).withColumn("stored", stored), "stored", "email", KEY)


@query("mask_block", with_ctes("SELECT c_custkey, CASE WHEN born = '' THEN '' ELSE '***' END AS born FROM cells", CELLS))
def mask_block(spark, d):
    return t.cells(spark, d).select("c_custkey", m.mask_block("born").alias("born"))


_BUCKET = "floor((TRY_CAST(amount AS DECIMAL(18,2)) - 7) / 250)::BIGINT * 250 + 7"


@query("mask_bucket", with_ctes(f"""
SELECT c_custkey, CASE WHEN amount = 'none' THEN '[REDACTED]' ELSE '[' || ({_BUCKET}) || ',' || ({_BUCKET} + 250) || ')' END AS amount
FROM cells""", CELLS))
def mask_bucket(spark, d):
    return t.cells(spark, d).select("c_custkey", m.mask_bucket("amount", 250, 7).alias("amount"))


@query("mask_date", with_ctes(f"""
SELECT c_custkey, CASE WHEN bad THEN '[REDACTED]' WHEN born = '' THEN '' ELSE substr(born, 1, 4) END AS y,
 CASE WHEN bad THEN '[REDACTED]' WHEN born = '' THEN '' ELSE substr(born, 1, 4) || 'Q' || q END AS q,
 CASE WHEN bad THEN '[REDACTED]' WHEN born = '' THEN '' ELSE substr(born, 1, 4) || '-' || mm END AS m
FROM (SELECT *, born = 'n/a' OR (born LIKE '%-02-29' AND NOT ({_LEAP})) AS bad,
  CASE c_custkey % 6 WHEN 1 THEN '1' WHEN 2 THEN '2' WHEN 3 THEN '3' ELSE '4' END AS q,
  CASE c_custkey % 6 WHEN 1 THEN '02' WHEN 2 THEN '06' WHEN 3 THEN '07' ELSE '11' END AS mm FROM cells)""", CELLS))
def mask_date(spark, d):
    return t.cells(spark, d).select(
        "c_custkey", *[m.mask_date("born", g).alias(g[0]) for g in ("year", "quarter", "month")]
    )


CONTACT_RULES = (
    r.MaskRule("phone", "phone", "mask"),
    r.MaskRule("email", "email", "hash"),
    r.MaskRule("client_ip", "ip", "mask"),
    r.MaskRule("card_no", "bankcard", "block"),
    r.MaskRule("c_acctbal", "number", "range", width=1000),
)


@query("redact_contacts", over_contact(f"""
SELECT c_custkey, c_nationkey, c_mktsegment, '[' || (floor(c_acctbal / 1000)::BIGINT * 1000) || ',' || (floor(c_acctbal / 1000)::BIGINT * 1000 + 1000) || ')' AS c_acctbal,
 substr(phone, 1, 3) || '****' || right(phone, 4) AS phone, {fingerprint_sql('email')} AS email,
 '10.' || (c_custkey % 256) || '.*.*' AS client_ip, '***' AS card_no FROM contact"""))
def redact_contacts(spark, d):
    return r.redact(t.contact(spark, d), CONTACT_RULES, KEY)


@query("redaction_report", over_contact("""
SELECT unnest(['phone','email','client_ip','card_no','c_acctbal']) AS column_name, unnest(['phone','email','ip','bankcard','number']) AS sensitive_type,
 count(*) AS masked_cells, 0::BIGINT AS hash_fallbacks, unnest([NULL, 2, NULL, NULL, NULL])::INT AS key_version FROM contact"""))
def redaction_report(spark, d):
    return r.redaction_report(t.contact(spark, d), CONTACT_RULES, KEY)


@query("redaction_observed", CHECK_SQL["redaction_report"])
def redaction_observed(spark, d):
    """The report that comes with writing the redacted table."""
    frame, report = r.redact_observed(t.contact(spark, d), CONTACT_RULES, KEY)
    frame.write.parquet(scratch_path(spark, "redacted"))
    return report()


RESULT_COLUMNS = f"result_columns AS ({t.RESULT_COLUMNS_SQL})"
_NAMED = """named AS (SELECT *, lower(trim(CASE WHEN result_name LIKE '"%"' THEN result_name[2:-2] ELSE result_name END)) AS rn,
 lower(source_column) AS sn FROM result_columns)"""
_TYPE_ORDER = "list_position(['phone','email','idcard','bankcard','ip','birthdate','generic','number','date'], sensitive_type) - 1"


@query("resolve_mask_rules", with_ctes(f"""
SELECT query_id, output_index, tier, CASE WHEN tier < 10 THEN rule_id END AS rule_id, sensitive_type,
 CASE WHEN tier < 10 THEN algorithm ELSE 'block' END AS algorithm
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, output_index ORDER BY tier, {_TYPE_ORDER}, rule_id) AS rk FROM (
 SELECT query_id, output_index, 1 AS tier, r.* FROM named JOIN rules r ON r.table_name = '' AND r.column_name = rn WHERE source_column <> '' AND result_name <> source_column
 UNION ALL SELECT query_id, output_index, 2, r.* FROM named JOIN rules r ON r.table_name <> '' AND r.schema_name <> '' AND r.schema_name = source_schema AND r.table_name = source_table AND r.column_name = sn
 UNION ALL SELECT query_id, output_index, 3, r.* FROM named JOIN rules r ON r.table_name <> '' AND r.schema_name = '' AND r.table_name = source_table AND r.column_name = sn
 UNION ALL SELECT query_id, output_index, 4, r.* FROM named JOIN rules r ON r.table_name = '' AND r.column_name = rn
 UNION ALL SELECT query_id, output_index, 5, r.* FROM named JOIN rules r ON r.table_name = '' AND r.column_name = sn WHERE source_column <> ''
 UNION ALL SELECT query_id, output_index, 10, r.* FROM named JOIN rules r ON r.table_name = possible_table AND (r.schema_name = '' OR r.schema_name = possible_schema)
   AND (r.column_name = rn OR (source_column <> '' AND r.column_name = sn)) WHERE source_table = '')) WHERE rk = 1
""", RESULT_COLUMNS, RULES, _NAMED))
def resolve_mask_rules(spark, d):
    return r.resolve_mask_rules(t.result_columns(spark, d), t.mask_rules(spark), ["query_id", "output_index"])


DEPENDENCIES = f"dependencies AS ({t.DEPENDENCIES_SQL})"
LINEAGE = f"lineage AS ({t.LINEAGE_SQL})"
_DEP_RULES = f"""dep_rules AS (SELECT l.query_id, l.output_index, l.arm_index, l.dep_index, r.rule_id, r.algorithm, {_TYPE_ORDER} AS ord,
  row_number() OVER (PARTITION BY l.query_id, l.output_index, l.arm_index, l.dep_index
   ORDER BY CASE WHEN r.table_name = '' THEN 3 WHEN r.schema_name = '' THEN 2 ELSE 1 END, r.rule_id) AS rk
 FROM lineage l JOIN rules r ON r.column_name = l.dep_column AND (r.table_name = '' OR (r.table_name = l.dep_table AND (r.schema_name = '' OR r.schema_name = l.dep_schema))))"""
_ARMS = f"""arms AS (SELECT l.query_id, l.output_index, l.arm_index, any_value(kind) AS kind, any_value(operation) AS op, any_value(status) AS status,
  count(DISTINCT l.dep_index) FILTER (dep_column IS NOT NULL) AS deps, max(dep_role) AS role, max(coalesce(dep_schema, '') || '.' || dep_table || '.' || dep_column) AS origin,
  max(d.rule_id) AS dep_rule, max(d.algorithm) AS dep_algorithm, min(d.ord) AS dep_ord, min(p.ord) AS pos_ord, max(g.rule_id) AS grule, max(g.algorithm) AS galgorithm, min(g.ord) AS gord
 FROM lineage l LEFT JOIN (SELECT * FROM dep_rules WHERE rk = 1) d ON (d.query_id, d.output_index, d.arm_index, d.dep_index) = (l.query_id, l.output_index, l.arm_index, l.dep_index)
 LEFT JOIN (SELECT schema_name, table_name, {_TYPE_ORDER} AS ord FROM rules WHERE table_name <> '') p ON p.table_name = l.possible_table AND p.schema_name IN ('', l.possible_schema)
 LEFT JOIN (SELECT rule_id, column_name, algorithm, {_TYPE_ORDER} AS ord FROM rules WHERE table_name = '') g ON g.column_name = l.result_name
 GROUP BY 1, 2, 3)"""
_JUDGED = """judged AS (SELECT *, status = 'source_free' AND deps = 0 AND (kind = 'constant' OR (kind = 'aggregate' AND op = 'aggregate:count')) AS free_ok,
  status = 'resolved' AND (kind = 'direct' OR (kind = 'transparent' AND op IN ('concat_empty', 'coalesce_null'))) AND deps = 1 AND role = 'value' AS simple,
  least(CASE WHEN NOT (status = 'source_free') THEN dep_ord END,
   CASE WHEN status = 'unresolved' OR (status = 'resolved' AND (kind = 'opaque' OR deps = 0)) THEN pos_ord END, gord) AS relevant FROM arms)"""
_DECIDED = """decided AS (SELECT *, CASE WHEN simple THEN coalesce(dep_rule, grule) WHEN free_ok THEN grule END AS chosen,
  NOT (simple AND ((dep_rule IS NOT NULL AND grule IS NOT NULL AND dep_rule <> grule)
   OR (kind = 'transparent' AND op = 'concat_empty' AND coalesce(dep_algorithm, galgorithm) = 'range'))) AS clean FROM judged)"""


@query("output_masks", with_ctes("""
SELECT query_id, output_index, CASE WHEN agreed THEN 'rule' ELSE 'block' END AS decision, CASE WHEN agreed THEN rule_low END AS rule_id,
 coalesce(CASE WHEN agreed THEN (SELECT sensitive_type FROM rules WHERE rule_id = rule_low)
  ELSE ['phone','email','idcard','bankcard','ip','birthdate','generic','number','date'][relevant + 1] END, 'generic') AS sensitive_type,
 NOT agreed AND uncertain AS unresolved
FROM (SELECT query_id, output_index, bool_and(chosen IS NOT NULL AND clean) AND min(chosen) = max(chosen)
   AND min(CASE WHEN simple THEN origin ELSE '' END) = max(CASE WHEN simple THEN origin ELSE '' END) AS agreed,
  min(chosen) AS rule_low, min(relevant) AS relevant, bool_or(status = 'unresolved') AS uncertain FROM decided GROUP BY 1, 2)
WHERE relevant IS NOT NULL""", DEPENDENCIES, LINEAGE, RULES, _DEP_RULES, _ARMS, _JUDGED, _DECIDED))
def output_masks(spark, d):
    return r.decide_output_masks(t.lineage(spark, d).drop("dep_index"), t.mask_rules(spark))


_CANDIDATES = """SELECT CAST(floor(o_orderkey / 6) AS BIGINT) AS query_id, CAST(o_orderkey % 2 AS INT) AS output_index, o_orderkey AS ordinal,
 CASE WHEN p % 5 = 0 THEN NULL WHEN p % 11 = 1 THEN 'hash' ELSE 'mask' END AS identity, 'text' AS input_type,
 CASE WHEN p % 13 = 0 THEN 'int' ELSE 'text' END AS type_digest, p % 17 <> 0 AS capable
 FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS p FROM orders) AS priced"""


@query("meet_masks", with_ctes("""
SELECT query_id, output_index, coalesce(min_by(reason, ordinal), 'ALLOW') AS reason,
 CASE WHEN count(reason) = 0 THEN min(chosen) END AS identity
FROM (SELECT *, CASE WHEN NOT capable THEN 'MASK_CAPABILITY_MISSING' WHEN input_type <> type_digest OR identity <> chosen THEN 'MASK_MEET_UNDEFINED' END AS reason
 FROM (SELECT *, first_value(identity) OVER (PARTITION BY query_id, output_index ORDER BY ordinal) AS chosen FROM candidates WHERE identity IS NOT NULL))
GROUP BY 1, 2""", f"candidates AS ({_CANDIDATES})"))
def meet_masks(spark, d):
    return r.meet_masks(t.select_over(spark, _CANDIDATES, "orders", t.load(spark, d, "orders")))

