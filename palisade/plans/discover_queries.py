"""Discovery queries: validators, name classification, evidence, scans and rule merges."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from palisade.functions import validators as v
from palisade.operators import discover
from palisade.plans.mask_queries import CELLS, RULES
from palisade.plans.registry import over_contact, query, with_ctes
from palisade.sources import tables as t

REF = dt.date(2024, 1, 1)
COLUMNS = f"names AS ({t.COLUMNS_SQL})"

_LUHN = """(list_sum(list_transform(range(1, length({c}) + 1), lambda i: CASE WHEN (length({c}) - i) % 2 = 0 THEN CAST(substr({c}, i, 1) AS INT)
 ELSE CASE WHEN 2 * CAST(substr({c}, i, 1) AS INT) > 9 THEN 2 * CAST(substr({c}, i, 1) AS INT) - 9 ELSE 2 * CAST(substr({c}, i, 1) AS INT) END END)) % 10 = 0)"""


@query("is_phone", with_ctes("SELECT c_custkey, regexp_full_match(phone, '(\\+86)?1[3-9][0-9]{9}') AS ok FROM cells", CELLS))
def is_phone(spark, d):
    return t.cells(spark, d).select("c_custkey", v.is_phone("phone").alias("ok"))


_EMAILS = """SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'a..b@x.io' WHEN 1 THEN concat('.u', CAST(c_custkey AS STRING), '@x.io')
 WHEN 2 THEN concat('u', CAST(c_custkey AS STRING), '@host') WHEN 3 THEN concat(repeat('a', 65), '@x.io') WHEN 4 THEN concat(' u', CAST(c_custkey AS STRING), '+t@mail.example.test ')
 WHEN 5 THEN concat('u', CAST(c_custkey AS STRING), '@-bad.io') ELSE concat('u.', CAST(c_custkey AS STRING), '@x.io') END AS mail FROM customer"""


@query("is_email", with_ctes("SELECT c_custkey, c_custkey % 7 IN (4, 6) AS ok FROM emails", f"emails AS ({_EMAILS})"))
def is_email(spark, d):
    return t.select_over(spark, _EMAILS, "customer", t.load(spark, d, "customer")).select("c_custkey", v.is_email("mail").alias("ok"))


@query("is_idcard", with_ctes("""
SELECT c_custkey, coalesce(CASE WHEN regexp_full_match(id_text, '[0-9]{15}') THEN try_strptime('19' || substr(id_text, 7, 6), '%Y%m%d') <= DATE '2024-01-01'
 WHEN regexp_full_match(upper(id_text), '[0-9]{17}[0-9X]') THEN try_strptime(substr(id_text, 7, 8), '%Y%m%d') <= DATE '2024-01-01'
  AND substr('10X98765432', (list_sum(list_transform(range(1, 18), lambda i: CAST(substr(id_text, i, 1) AS INT) * [7,9,10,5,8,4,2,1,6,3,7,9,10,5,8,4,2][i])) % 11)::INT + 1, 1) = upper(substr(id_text, 18, 1)) END, false) AS ok
FROM cells""", CELLS))
def is_idcard(spark, d):
    return t.cells(spark, d).select("c_custkey", v.is_idcard("id_text", REF).alias("ok"))


@query("is_bankcard", over_contact(f"SELECT c_custkey, {_LUHN.format(c='card_no')} AS ok FROM contact"))
def is_bankcard(spark, d):
    return t.contact(spark, d).select("c_custkey", v.is_bankcard("card_no").alias("ok"))


@query("is_ip", with_ctes("SELECT c_custkey, c_custkey % 5 <> 2 AS ok FROM cells", CELLS))
def is_ip(spark, d):
    return t.cells(spark, d).select("c_custkey", v.is_ip("ip_text").alias("ok"))


_BORN = """born_rows AS (SELECT *, coalesce(try_strptime(born, '%Y-%m-%d'), try_strptime(born, '%Y/%m/%d'), try_strptime(born, '%Y%m%d'),
 try_strptime(born, '%Y-%m-%d %H:%M:%S'))::DATE AS b FROM cells)"""


@query("is_birthdate", with_ctes("""
SELECT c_custkey, coalesce(b <= DATE '2024-01-01' AND 2024 - year(b) - CASE WHEN (month(b), day(b)) > (1, 1) THEN 1 ELSE 0 END BETWEEN 0 AND 120, false) AS ok
FROM born_rows""", CELLS, _BORN))
def is_birthdate(spark, d):
    return t.cells(spark, d).select("c_custkey", v.is_birthdate("born", REF).alias("ok"))


@query("is_number", with_ctes(r"SELECT c_custkey, regexp_full_match(amount, '[+-]?[0-9]+(\.[0-9]+)?') AS ok FROM cells", CELLS))
def is_number(spark, d):
    return t.cells(spark, d).select("c_custkey", v.is_number("amount").alias("ok"))


@query("is_date_text", with_ctes("""
SELECT c_custkey, coalesce(b IS NOT NULL AND NOT regexp_full_match(born, '[0-9]+'), false) AS ok FROM born_rows""", CELLS, _BORN))
def is_date_text(spark, d):
    return t.cells(spark, d).select("c_custkey", v.is_date_text("born").alias("ok"))


# The same name splitting in the other engine, which has no look-around.
_TOKENS = r"""tokens AS (SELECT *, list_filter(string_split(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
 column_name, '[^A-Za-z0-9]+', ' ', 'g'), '([a-z])([A-Z])', '\1 \2', 'g'), '([0-9])([A-Za-z])', '\1 \2', 'g'), '([A-Za-z])([0-9])', '\1 \2', 'g'),
 '([A-Z])([A-Z][a-z])', '\1 \2', 'g')), ' '), lambda x: x <> '') AS parts FROM names)"""


@query("name_tokens", with_ctes("SELECT column_id, array_to_string(parts, ' ') AS tokens FROM tokens", COLUMNS, _TOKENS))
def name_tokens(spark, d):
    return t.column_names(spark, d).select("column_id", F.array_join(discover.name_tokens("column_name"), " ").alias("tokens"))


_PHRASES = "phrases(rk, phrase, category, strength) AS (VALUES " + ", ".join(
    f"({i}, '{p}', '{c}', '{s}')" for i, (p, c, s) in enumerate(discover._ranked_phrases())
) + ")"


@query("classify_columns", with_ctes("""
SELECT column_id, column_name, category, strength, 'column_name_' || strength || '_' || category AS signal
FROM (SELECT n.*, p.category, p.strength, row_number() OVER (PARTITION BY column_id ORDER BY p.rk) AS best
 FROM tokens n JOIN phrases p ON contains(' ' || array_to_string(parts, ' ') || ' ', ' ' || p.phrase || ' ')) WHERE best = 1""", COLUMNS, _TOKENS, _PHRASES))
def classify_columns(spark, d):
    return discover.classify_columns(t.column_names(spark, d)).select("column_id", "column_name", "category", "strength", "signal")


@query("classify_allowed", with_ctes("""
SELECT column_id, category FROM (SELECT column_id, p.category, row_number() OVER (PARTITION BY column_id ORDER BY p.rk) AS best
 FROM tokens n JOIN phrases p ON contains(' ' || array_to_string(parts, ' ') || ' ', ' ' || p.phrase || ' '))
WHERE best = 1 AND category IN ('phone', 'date')""", COLUMNS, _TOKENS, _PHRASES))
def classify_allowed(spark, d):
    return discover.classify_columns(t.column_names(spark, d), ["phone", "date"]).select("column_id", "category")


_CANDIDATES = {"phone": "phone", "ip_text": "ip", "id_text": "idcard", "born": "birthdate", "amount": "number"}
_COUNTS = """counts AS (SELECT 'phone' AS column_name, 'phone' AS category, 'strong' AS strength, count(*) FILTER (trim(phone) <> '') AS eligible,
  count(*) FILTER (regexp_full_match(phone, '(\\+86)?1[3-9][0-9]{9}')) AS matched FROM cells
 UNION ALL SELECT 'ip_text', 'ip', 'strong', count(*), count(*) FILTER (c_custkey % 5 <> 2) FROM cells
 UNION ALL SELECT 'born', 'date', 'strong', count(*) FILTER (born <> ''), count(*) FILTER (b IS NOT NULL AND NOT regexp_full_match(born, '[0-9]+')) FROM born_rows
 UNION ALL SELECT 'amount', 'number', 'medium', count(*), count(*) FILTER (regexp_full_match(amount, '[+-]?[0-9]+(\\.[0-9]+)?')) FROM cells)"""
_WANTED = {"phone": "phone", "ip_text": "ip", "born": "date", "amount": "number"}


@query("profile_evidence", with_ctes("SELECT column_name, category, eligible, matched FROM counts", CELLS, _BORN, _COUNTS))
def profile_evidence(spark, d):
    return discover.profile_evidence(t.cells(spark, d), _WANTED, REF)


@query("score_findings", with_ctes("""
SELECT column_name, category, strength, CASE WHEN strength = 'strong' AND eligible >= 3 AND matched * 100 >= eligible * 80 THEN CASE WHEN category IN ('number', 'date') THEN 'medium' ELSE 'high' END ELSE 'medium' END AS confidence
FROM counts WHERE CASE WHEN strength = 'strong' THEN NOT (eligible >= 3 AND matched * 100 < eligible * 50) ELSE eligible >= 3 AND matched * 100 >= eligible * 80 END""", CELLS, _BORN, _COUNTS))
def score_findings(spark, d):
    evidence = discover.profile_evidence(t.cells(spark, d), _WANTED, REF)
    strength = F.when(F.col("column_name") == "amount", "medium").otherwise("strong")
    return discover.score_findings(evidence.withColumn("strength", strength)).select("column_name", "category", "strength", "confidence")


_CLASSIFIED = """classified AS (SELECT column_id, p.category, p.strength, row_number() OVER (PARTITION BY column_id ORDER BY p.rk) AS best, ordinal
 FROM tokens n JOIN phrases p ON contains(' ' || array_to_string(parts, ' ') || ' ', ' ' || p.phrase || ' '))"""


@query("advise_rules", with_ctes("""
SELECT column_id, category, CASE WHEN category = 'generic' AND strength <> 'strong' THEN NULL WHEN category = 'number' THEN CASE WHEN ordinal % 3 > 0 THEN 'range' ELSE 'block' END
 WHEN category = 'date' THEN 'range' WHEN category = 'generic' THEN 'block' ELSE 'mask' END AS algorithm,
 CASE WHEN category = 'number' AND ordinal % 3 > 0 THEN ordinal % 3 END::BIGINT AS bucket_width, CASE WHEN category = 'date' THEN 'month' END AS granularity,
 category = 'generic' AND strength <> 'strong' AS manual_review FROM classified WHERE best = 1""", COLUMNS, _TOKENS, _PHRASES, _CLASSIFIED))
def advise_rules(spark, d):
    named = discover.classify_columns(t.column_names(spark, d)).withColumn("hint", (F.col("ordinal") % 3).cast("bigint"))
    return discover.advise(named, "hint").select("column_id", "category", "algorithm", "bucket_width", "granularity", "manual_review")


@query("scan_tables", with_ctes(f"""
SELECT * FROM (VALUES ('contact', 'phone', 'phone', 'high', 'mask'), ('contact', 'email', 'email', 'high', 'mask'), ('contact', 'client_ip', 'ip', 'high', 'mask'))
 v(table_name, column_name, category, confidence, algorithm)
UNION ALL SELECT 'cells', 'phone', 'phone', CASE WHEN share >= 0.8 THEN 'high' ELSE 'medium' END, 'mask' FROM (SELECT avg((phone <> 'NULL')::INT) AS share FROM cells)
UNION ALL SELECT 'cells', 'ip_text', 'ip', CASE WHEN share >= 0.8 THEN 'high' ELSE 'medium' END, 'mask' FROM (SELECT avg((c_custkey % 5 <> 2)::INT) AS share FROM cells)
UNION ALL SELECT 'cells', 'amount', 'number', 'medium', 'block'
UNION ALL SELECT 'contact', 'card_no', 'bankcard', 'medium', 'mask' FROM (SELECT avg({_LUHN.format(c='card_no')}::INT) AS share FROM contact) WHERE share >= 0.8""",
    f"contact AS ({t.CONTACT_SQL})", CELLS))
def scan_tables(spark, d):
    findings, _ = discover.scan_tables({"contact": t.contact(spark, d), "cells": t.cells(spark, d)}, REF)
    return findings.select("table_name", "column_name", "category", "confidence", "algorithm")


_DRAFTS = """SELECT column_id AS draft_id, concat('ds-', CAST(ordinal % 3 AS STRING)) AS datasource_id, schema_name, table_name,
 CASE ordinal % 5 WHEN 0 THEN 'Phone' WHEN 1 THEN 'email ' WHEN 2 THEN 'card_no' WHEN 3 THEN 'note' ELSE 'total' END AS column_name,
 CASE ordinal % 5 WHEN 0 THEN 'phone' WHEN 1 THEN 'email' WHEN 2 THEN 'bankcard' WHEN 3 THEN 'generic' ELSE 'number' END AS sensitive_type,
 CASE WHEN ordinal % 5 IN (3, 4) THEN 'block' ELSE 'mask' END AS algorithm, CAST(NULL AS BIGINT) AS bucket_width, CAST(NULL AS STRING) AS granularity FROM names"""
_HELD = """SELECT rule_id, CASE WHEN rule_id IN ('r1', 'r2') THEN 'ds-1' ELSE 'ds-2' END AS datasource_id,
 CASE WHEN rule_id IN ('r1', 'r2') THEN '' ELSE 's1' END AS schema_name, CASE WHEN rule_id IN ('r1', 'r2') THEN '' ELSE table_name END AS table_name,
 column_name, sensitive_type, algorithm, CAST(NULL AS BIGINT) AS bucket_width, CAST(NULL AS STRING) AS granularity, true AS enabled FROM rules"""


@query("plan_rule_merge", with_ctes("""
SELECT draft_id, CASE WHEN outcome = 'create' AND max(outcome = 'conflict') OVER () THEN 'withheld' ELSE outcome END AS outcome, rule_id
FROM (SELECT d.draft_id, CASE WHEN s.rule_id IS NOT NULL THEN CASE WHEN s.sensitive_type = d.sensitive_type AND s.algorithm = d.algorithm THEN 'existing' ELSE 'conflict' END
  WHEN g.rule_id IS NOT NULL THEN 'covered_by_global' WHEN f.draft_id <> d.draft_id THEN CASE WHEN f.sensitive_type = d.sensitive_type AND f.algorithm = d.algorithm THEN 'existing' ELSE 'conflict' END
  ELSE 'create' END AS outcome, coalesce(s.rule_id, g.rule_id) AS rule_id
 FROM drafts d LEFT JOIN held s ON (s.datasource_id, s.schema_name, s.table_name, s.column_name) = (d.datasource_id, d.schema_name, d.table_name, lower(trim(d.column_name)))
 LEFT JOIN held g ON g.table_name = '' AND g.datasource_id = d.datasource_id AND g.column_name = lower(trim(d.column_name))
 JOIN (SELECT *, row_number() OVER (PARTITION BY datasource_id, schema_name, table_name, lower(trim(column_name)) ORDER BY draft_id) AS rk FROM drafts) f
  ON f.rk = 1 AND (f.datasource_id, f.schema_name, f.table_name, lower(trim(f.column_name))) = (d.datasource_id, d.schema_name, d.table_name, lower(trim(d.column_name))))""",
    COLUMNS, RULES, f"drafts AS ({_DRAFTS})", f"held AS ({_HELD})"))
def plan_rule_merge(spark, d):
    drafts = t.select_over(spark, _DRAFTS, "names", t.column_names(spark, d))
    held = t.select_over(spark, _HELD, "rules", t.mask_rules(spark))
    return discover.plan_rule_merge(drafts, held)
