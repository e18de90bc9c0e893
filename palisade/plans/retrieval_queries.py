"""Schema texts, keyword and vector ranking, vocabulary, mentions, charts and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.operators import retrieval as r
from palisade.operators import series as s
from palisade.operators import vectors as v
from palisade.plans.registry import over_audit, query, with_ctes
from palisade.session import scratch_path
from palisade.sources import tables as t
from palisade.sources import versions

_QUESTIONS = """SELECT conv_id * 1000 + turn AS question_id, concat('ds-', CAST(conv_id % 5 AS STRING)) AS datasource_id, text FROM conversations WHERE role = 'user'"""
_TERMS = """SELECT item_id AS term_id, split_part(text, ' ', 3) AS word, concat('term ', CAST(item_id AS STRING)) AS description,
 split_part(text, ' ', 4) AS other_1, concat(split_part(text, ' ', 5), ' ', split_part(text, ' ', 6)) AS other_2, item_id % 7 <> 0 AS enabled, item_id % 3 = 0 AS specific FROM benchmark"""
QUESTIONS, TERMS = f"questions AS ({_QUESTIONS})", f"terms AS ({_TERMS})"


def questions(spark, d):
    return t.select_over(spark, _QUESTIONS, "conversations", t.load(spark, d, "conversations"))


def terms(spark, d):
    flat = t.select_over(spark, _TERMS, "benchmark", t.load(spark, d, "benchmark"))
    return flat.withColumns(
        {
            "other_words": F.array("other_1", "other_2"),
            "datasource_ids": F.when(F.col("specific"), F.array(F.lit("ds-1"), F.lit("ds-2"))).otherwise(F.array().cast("array<string>")),
        }
    ).drop("other_1", "other_2", "specific")


_CATALOG = f"names AS ({t.COLUMNS_SQL})"
_REMARKS = """SELECT schema_name, table_name, CASE WHEN column_id % 9 = 0 THEN '' ELSE column_name END AS column_name, min(concat('about ', comment)) AS remark FROM names WHERE column_id % 3 = 0 GROUP BY 1, 2, 3"""
_TEXTS = """texts AS (SELECT c.schema_name, c.table_name, '# Table: ' || c.table_name || CASE WHEN max(tr.remark) IS NOT NULL THEN ', ' || max(tr.remark) ELSE '' END || chr(10) || '[' || chr(10)
 || string_agg('(' || c.column_name || ':' || CASE WHEN c.ordinal % 2 = 0 THEN 'string' ELSE 'int' END || CASE WHEN cr.remark IS NOT NULL THEN ', ' || cr.remark ELSE '' END || ')', ',' || chr(10) ORDER BY c.ordinal) || chr(10) || ']' || chr(10) AS schema_text
 FROM names c LEFT JOIN remarks cr ON cr.column_name <> '' AND (cr.schema_name, cr.table_name, cr.column_name) = (c.schema_name, c.table_name, c.column_name)
 LEFT JOIN remarks tr ON tr.column_name = '' AND (tr.schema_name, tr.table_name) = (c.schema_name, c.table_name) GROUP BY c.schema_name, c.table_name)"""


def _schema_texts(spark, d):
    names = t.column_names(spark, d)
    typed = names.withColumn("data_type", F.when(F.col("ordinal") % 2 == 0, "string").otherwise("int"))
    return r.schema_text(typed, t.select_over(spark, _REMARKS, "names", names))


@query("schema_text", with_ctes("SELECT * FROM texts", _CATALOG, f"remarks AS ({_REMARKS})", _TEXTS))
def schema_text(spark, d):
    return _schema_texts(spark, d)


@query("changed_texts", with_ctes("""
SELECT schema_name, table_name, fingerprint FROM (SELECT *, sha256(encode('model-1') || from_hex('00') || encode(schema_text)) AS fingerprint FROM texts) WHERE CAST(substr(table_name, 2) AS INT) % 4 = 0""",
    _CATALOG, f"remarks AS ({_REMARKS})", _TEXTS))
def changed_texts(spark, d):
    """The index is stale for every fourth table: those texts come back."""
    texts = _schema_texts(spark, d)
    stale = F.substr("table_name", F.lit(2)).cast("int") % 4 == 0
    held = F.when(stale, F.lit("old")).otherwise(r.text_fingerprint("model-1", F.col("schema_text")))
    index = texts.select("schema_name", "table_name", held.alias("fingerprint"))
    return r.changed_texts(texts, index, "model-1", ["schema_name", "table_name"]).select("schema_name", "table_name", "fingerprint")


@query("index_write_back", with_ctes("""
SELECT schema_name, table_name, sha256(encode('model-1') || from_hex('00') || encode(schema_text)) AS fingerprint, 2 AS version FROM texts""", _CATALOG, f"remarks AS ({_REMARKS})", _TEXTS))
def index_write_back(spark, d):
    """An index whose texts of every fourth table are stale, brought up to date; a further run finds nothing to write."""
    texts = _schema_texts(spark, d)
    printed = texts.select("schema_name", "table_name", r.text_fingerprint("model-1", F.col("schema_text")).alias("fingerprint"))
    stale = F.substr("table_name", F.lit(2)).cast("int") % 4 == 0
    root, keys = scratch_path(spark, "index"), ["schema_name", "table_name"]
    versions.merge_version(printed.withColumn("fingerprint", F.when(stale, "old").otherwise(F.col("fingerprint"))), root, keys, "fingerprint")
    versions.merge_version(printed, root, keys, "fingerprint")
    version, written = versions.merge_version(printed, root, keys, "fingerprint")
    return versions.read_version(spark, root, printed.schema).withColumn("version", F.lit(version + len(written)))


_TABLES = """SELECT p_partkey AS table_id, concat(replace(p_name, ' ', '_'), CASE WHEN p_partkey % 3 = 0 THEN concat('_', lower(p_type)) ELSE '' END) AS name,
 CASE p_size % 4 WHEN 0 THEN concat('All ', p_brand, ' ', lower(p_type)) WHEN 1 THEN p_name ELSE '' END AS comment FROM part"""
_FIELDS = """SELECT p_partkey AS table_id, concat('f_', split_part(p_name, ' ', 2)) AS field_name, CASE WHEN p_size % 3 = 0 THEN lower(p_type) ELSE '' END AS comment FROM part
 UNION ALL SELECT p_partkey, concat(lower(p_type), '_code'), CASE WHEN p_size % 5 = 0 THEN concat('code of ', p_name) ELSE '' END FROM part"""
_KEYWORDS = """SELECT question_id, concat(CASE question_id % 7 WHEN 0 THEN 'ring' WHEN 1 THEN 'Small' WHEN 2 THEN 'economy' WHEN 3 THEN 'red widget' WHEN 4 THEN 'hot_gear' WHEN 5 THEN 'brand#2 ' ELSE 'promo' END,
 ',', CASE question_id % 5 WHEN 0 THEN 'gizmo' WHEN 1 THEN 'ring' WHEN 2 THEN 'none' WHEN 3 THEN 'large' ELSE '' END) AS keywords FROM questions"""
_KEYWORD_ROWS = "kw AS (SELECT question_id, lower(trim(k)) AS keyword FROM (SELECT question_id, unnest(string_split(keywords, ',')) AS k FROM keywords) WHERE trim(k) <> '')"
_PARTS = """pairs AS (SELECT w.keyword, t.table_id, lower(t.name) = w.keyword AS n, comment <> '' AND lower(t.comment) = w.keyword AS c, comment <> '' AND contains(lower(t.comment), w.keyword) AS ic,
  list_contains(string_split(lower(t.name), '_'), w.keyword) AS p, EXISTS (SELECT 1 FROM fields f WHERE f.table_id = t.table_id AND f.comment <> '' AND lower(f.comment) = w.keyword) AS fc,
  EXISTS (SELECT 1 FROM fields f WHERE f.table_id = t.table_id AND f.comment <> '' AND contains(lower(f.comment), w.keyword)) AS fic,
  EXISTS (SELECT 1 FROM fields f WHERE f.table_id = t.table_id AND list_contains(string_split(lower(f.field_name), '_'), w.keyword)) AS fp, len(list_distinct(string_split(lower(t.name), '_'))) AS parts
 FROM (SELECT DISTINCT keyword FROM kw) w, tables t),
 scored AS (SELECT *, CASE WHEN n THEN 1.0 WHEN c THEN 0.9 WHEN ic THEN 0.7 WHEN fc THEN 0.5 WHEN fic THEN 0.4 WHEN fp THEN 0.3 ELSE 0.0 END::DOUBLE AS base FROM pairs WHERE n OR c OR ic OR p OR fc OR fic OR fp),
 mixed AS (SELECT k.question_id, s.table_id, bool_or(n) AS n, bool_or(c AND NOT n) AS c, max(base) AS best, count(DISTINCT k.keyword) AS scored, count(*) FILTER (p) AS hits, max(parts) AS parts,
  (SELECT count(*) FROM kw q WHERE q.question_id = k.question_id) AS total FROM kw k JOIN scored s ON s.keyword = k.keyword GROUP BY 1, 2),
 scores AS (SELECT question_id, table_id, CASE WHEN n THEN 1.0 WHEN c THEN 0.9 ELSE round_even(greatest(best, CASE WHEN hits > 0 THEN round_even(0.25::DOUBLE + 0.25::DOUBLE * hits / parts, 2) ELSE 0 END) * scored / total, 2) END::DOUBLE AS score FROM mixed)"""
_SCORE_CTES = (QUESTIONS, f"tables AS ({_TABLES})", f"fields AS ({_FIELDS})", f"keywords AS ({_KEYWORDS})", _KEYWORD_ROWS, _PARTS)


def _keyword_inputs(spark, d):
    """Tables, their fields and the keywords of each question."""
    part = t.load(spark, d, "part")
    tables, fields = t.select_over(spark, _TABLES, "part", part), t.select_over(spark, _FIELDS, "part", part)
    listed = t.select_over(spark, _KEYWORDS, "questions", questions(spark, d))
    words = listed.select("question_id", F.explode(F.split("keywords", ",")).alias("keyword"))
    return tables, fields, words


_BEST = f"best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, table_id) AS rank FROM scores) WHERE rank <= {r.BEST_TABLES})"


@query("keyword_scores", with_ctes("SELECT question_id, table_id, score FROM scores", *_SCORE_CTES))
def keyword_scores(spark, d):
    """Every table that a question's keywords touch; the result grows with questions times tables."""
    return r.keyword_scores(*_keyword_inputs(spark, d), unnamed=True)


_VECTORS = "vecs AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)"


def _vectors(spark, d):
    return t.load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _queries(spark, d):
    """Every vector of one label asks; the number of queries grows with the table."""
    return _vectors(spark, d).filter(F.col("label") == 3)


def _top_sql(measure, threshold=""):
    return f"""SELECT query_id, candidate_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id) AS rank FROM (
 SELECT q.vec_id AS query_id, c.vec_id AS candidate_id, round({measure}(q.e, c.e), 12) AS score FROM vecs c, (SELECT * FROM vecs JOIN (SELECT vec_id FROM embeddings WHERE label = 3) USING (vec_id)) q) {threshold}) WHERE rank <= 5"""


def _shown(df):
    return df.withColumns({"score": F.round("score", 6), "rank": F.col("rank").cast("bigint")})


@query("dot_top_k", with_ctes(_top_sql("list_dot_product", "WHERE score > 0.1"), _VECTORS))
def dot_top_k(spark, d):
    return _shown(v.top_k(_vectors(spark, d), _queries(spark, d), 5, threshold=0.1, cosine=False))


@query("cosine_top_k", with_ctes(_top_sql("list_cosine_similarity"), _VECTORS))
def cosine_top_k(spark, d):
    return _shown(v.top_k(_vectors(spark, d), _queries(spark, d), 5))


@query("cosine_top_k_blocked", with_ctes(_top_sql("list_cosine_similarity"), _VECTORS))
def cosine_top_k_blocked(spark, d):
    """The same ranking in several scans, as for more queries than one scan answers."""
    queries = _queries(spark, d)
    return _shown(v.top_k(_vectors(spark, d), queries, 5, queries_per_scan=max(1, queries.count() // 3)))


@query("vector_search", with_ctes("""
SELECT candidate_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, candidate_id) AS rank FROM (
 SELECT vec_id AS candidate_id, round(list_cosine_similarity(embedding::DOUBLE[], list_transform(range(1, 65), lambda i: (i % 5)::DOUBLE)), 12) AS score FROM embeddings WHERE vec_id % 2 = 1 AND label = 4)) WHERE rank <= 10""", "one AS (SELECT 1)"))
def vector_search(spark, d):
    tenant = F.concat(F.lit("t"), (F.col("id") % 2).cast("string"))
    asked = [float(i % 5) for i in range(1, 65)]
    return _shown(v.vector_search(_vectors(spark, d).withColumn("tenant_id", tenant), asked, {"label": 4}, "t1", 10))


_HYBRID = """SELECT question_id, table_id, CAST(table_id AS INT) AS idx, CAST((question_id * 7 + table_id * 13) % 101 AS DOUBLE) / 100 AS vector, score AS keyword, (question_id + table_id) % 97 = 0 AS explicit FROM best"""


@query("hybrid_rank", with_ctes("""
SELECT question_id, table_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY (keyword = 1)::INT DESC, explicit::INT DESC, vector * 0.6::DOUBLE + keyword * 0.4::DOUBLE DESC, idx) AS rank FROM hybrid)
WHERE rank <= 6 OR explicit""", *_SCORE_CTES, _BEST, f"hybrid AS ({_HYBRID})"))
def hybrid_rank(spark, d):
    scored = t.select_over(spark, _HYBRID, "best", r.best_tables(*_keyword_inputs(spark, d))).withColumnRenamed("idx", "index")
    return v.hybrid_rank(scored, 0.6, 6).select("question_id", "table_id", F.col("rank").cast("bigint").alias("rank"))


_NAMED = "named AS (SELECT term_id, lower(unnest([word, other_1, other_2])) AS phrase FROM terms WHERE enabled)"


@query("match_vocabulary", with_ctes("""
SELECT question_id, term_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY term_id) AS rank FROM (
 SELECT DISTINCT q.question_id, n.term_id FROM questions q JOIN named n ON n.phrase <> '' AND contains(lower(q.text), n.phrase) JOIN terms t ON t.term_id = n.term_id WHERE NOT specific OR datasource_id IN ('ds-1', 'ds-2'))) WHERE rank <= 8""",
    QUESTIONS, TERMS, _NAMED))
def match_vocabulary(spark, d):
    return r.match_vocabulary(questions(spark, d), terms(spark, d)).select("question_id", "term_id", F.col("rank").cast("bigint").alias("rank"))


_ASKED_WORDS = """SELECT question_id, concat(split_part(text, ' ', 1), ', ', split_part(text, ' ', 3), ',', split_part(text, ' ', 1), ',', CASE question_id % 3 WHEN 0 THEN 'the' WHEN 1 THEN 'of' ELSE 'in' END) AS keywords FROM questions"""


@query("expand_keywords", with_ctes("""
SELECT question_id, string_agg(word, ',' ORDER BY rank) AS expanded FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY place) AS rank FROM (
 SELECT question_id, min(place) AS place, min_by(word, place) AS word FROM (
  SELECT question_id, [0, pos, 0, 0] AS place, trim(raw) AS word FROM asked
  UNION ALL SELECT a.question_id, [1, pos, t.term_id, u.name_at], u.word FROM asked a JOIN (SELECT * FROM terms WHERE enabled) t ON lower(trim(a.raw)) IN (lower(trim(word)), lower(trim(other_1)), lower(trim(other_2))),
   LATERAL (SELECT unnest([0, 1, 2]) AS name_at, trim(unnest([t.word, t.other_1, t.other_2])) AS word) u) WHERE word <> '' GROUP BY question_id, lower(word))) WHERE rank <= 10 GROUP BY 1""",
    QUESTIONS, TERMS, f"keywords AS ({_ASKED_WORDS})", "asked AS (SELECT question_id, unnest(range(len(l))) AS pos, unnest(l) AS raw FROM (SELECT question_id, string_split(keywords, ',') AS l FROM keywords))"))
def expand_keywords(spark, d):
    return r.expand_keywords(t.select_over(spark, _ASKED_WORDS, "questions", questions(spark, d)), terms(spark, d))


_MENTION_NAMES = "SELECT DISTINCT lower(split_part(text, ' ', 4)) AS name FROM benchmark UNION SELECT DISTINCT lower(concat(split_part(text, ' ', 4), ' ', split_part(text, ' ', 5))) FROM benchmark UNION SELECT DISTINCT lower(split_part(text, ' ', 7)) FROM benchmark"

def _mentions_sql(names: str) -> str:
    return rf"""SELECT DISTINCT question_id, name FROM (SELECT *, max(e) OVER (PARTITION BY question_id ORDER BY b, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS furthest FROM (
 SELECT q.question_id, n.name, unnest(list_filter(range(1, length(x) + 1), lambda i: substr(x, i, length(name)) = name
   AND (i = 1 OR NOT regexp_matches(substr(name, 1, 1), '[A-Za-z0-9_]') OR NOT regexp_matches(substr(x, i - 1, 1), '[A-Za-z0-9_]'))
   AND (NOT regexp_matches(right(name, 1), '[A-Za-z0-9_]') OR NOT regexp_matches(substr(x, i + length(name), 1), '[A-Za-z0-9_]')))) AS b, b + length(name) AS e
 FROM (SELECT question_id, lower(text) AS x FROM questions) q JOIN ({names}) n ON n.name <> '' AND contains(x, n.name)))
WHERE furthest IS NULL OR e > furthest"""


@query("find_mentions", with_ctes(_mentions_sql("SELECT * FROM names"), QUESTIONS, f"names AS ({_MENTION_NAMES})"))
def find_mentions(spark, d):
    names = t.select_over(spark, _MENTION_NAMES, "benchmark", t.load(spark, d, "benchmark"))
    return r.find_mentions(questions(spark, d), names)


_COMMENTED = """SELECT item_id AS table_key, split_part(text, ' ', 4) AS name, concat(split_part(text, ' ', 5), ' ', split_part(text, ' ', 6)) AS comment FROM benchmark
 UNION ALL SELECT item_id + 100000, concat(split_part(text, ' ', 4), ' ', split_part(text, ' ', 5)), upper(split_part(text, ' ', 7)) FROM benchmark"""


@query("mentioned_tables", with_ctes(f"""
SELECT DISTINCT question_id, table_key FROM ({_mentions_sql("SELECT DISTINCT lower(trim(name)) AS name FROM commented")}) JOIN commented c ON lower(trim(c.name)) = name
UNION SELECT DISTINCT question_id, table_key FROM ({_mentions_sql("SELECT DISTINCT lower(trim(comment)) AS name FROM commented")}) m JOIN commented c ON lower(trim(c.comment)) = m.name""".replace(") JOIN commented c ON lower(trim(c.name)) = name", ") m JOIN commented c ON lower(trim(c.name)) = m.name"), QUESTIONS, f"commented AS ({_COMMENTED})"))
def mentioned_tables(spark, d):
    tables = t.select_over(spark, _COMMENTED, "benchmark", t.load(spark, d, "benchmark"))
    return r.mentioned_tables(questions(spark, d), tables)


# Every whole text is an example, and some of their words are short ones beside them.
_EXAMPLES = """SELECT conv_id * 1000 + turn AS example_id, text AS question, 'sql' AS description, conv_id % 9 <> 0 AS enabled FROM conversations WHERE role = 'user'
 UNION ALL SELECT 1000000000000 + conv_id * 1000 + turn, split_part(text, ' ', 3), 'sql', conv_id % 9 <> 0 FROM conversations WHERE role = 'user' AND turn % 3 <> 0"""


@query("match_examples", with_ctes("""
SELECT question_id, example_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY example_id) AS rank FROM (
 SELECT q.question_id, e.example_id FROM questions q JOIN examples e ON trim(e.question) <> '' AND (contains(lower(trim(q.text)), lower(trim(e.question))) OR contains(lower(trim(e.question)), lower(trim(q.text))))
 WHERE e.enabled)) WHERE rank <= 4""", QUESTIONS, f"examples AS ({_EXAMPLES})"))
def match_examples(spark, d):
    examples = t.select_over(spark, _EXAMPLES, "conversations", t.load(spark, d, "conversations"))
    return r.match_examples(questions(spark, d), examples).select("question_id", "example_id", F.col("rank").cast("bigint").alias("rank"))


@query("numeric_fields", with_ctes("""
SELECT 'id_text' AS field, coalesce(bool_and(regexp_full_match(id_text, '-?(0|[1-9][0-9]*)') AND abs(TRY_CAST(id_text AS DOUBLE)) < 9007199254740991), false) AS numeric, count(id_text) AS present FROM cells
UNION ALL SELECT 'amount', coalesce(bool_and(regexp_full_match(amount, '-?(0|[1-9][0-9]*)(\\.[0-9]+)?')), false), count(amount) FROM cells
UNION ALL SELECT 'c_custkey', true, count(c_custkey) FROM cells
UNION ALL SELECT 'phone', coalesce(bool_and(regexp_full_match(phone, '-?(0|[1-9][0-9]*)')), false), count(phone) FROM cells""", f"cells AS ({t.CELLS_SQL})"))
def numeric_fields(spark, d):
    return s.numeric_fields(t.cells(spark, d).select("id_text", "amount", "c_custkey", "phone"))


_DAILY = """SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS day, count(*) AS orders, CASE WHEN count(*) > 1 THEN round(sum(o_totalprice), 2) END AS revenue FROM orders GROUP BY 1, 2"""


def _daily(spark, d):
    return t.select_over(spark, _DAILY, "orders", t.load(spark, d, "orders"))


@query("chart_series", with_ctes("""
SELECT label, measure, value FROM (SELECT strftime(day, '%Y-%m-%d') AS label, unnest(['orders', 'revenue']) AS measure, unnest([orders::DOUBLE, revenue]) AS value FROM (
 SELECT day, sum(orders)::BIGINT AS orders, CASE WHEN min(revenue IS NOT NULL) THEN round(sum(revenue), 2) END AS revenue FROM daily GROUP BY 1 ORDER BY day LIMIT 20))""", f"daily AS ({_DAILY})"))
def chart_series(spark, d):
    per_day = _daily(spark, d).groupBy("day").agg(
        F.sum("orders").alias("orders"), F.when(F.bool_and(F.col("revenue").isNotNull()), F.round(F.sum("revenue"), 2)).alias("revenue")
    )
    return s.chart_series(per_day, "day", ["orders", "revenue"], ["day"])


@query("pie_shares", with_ctes("""
SELECT label, value, round(value / sum(value) OVER (), 9) AS share FROM (SELECT strftime(day, '%Y-%m-%d') AS label, sum(orders)::DOUBLE AS value FROM daily GROUP BY day ORDER BY day LIMIT 20)""", f"daily AS ({_DAILY})"))
def pie_shares(spark, d):
    per_day = _daily(spark, d).groupBy("day").agg(F.sum("orders").alias("orders"))
    return s.shares(per_day, "day", "orders", ["day"]).withColumn("share", F.round("share", 9))


_MONTHLY = """SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS month, round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY 1, 2"""

@query("forecast_months", with_ctes("""
SELECT o_orderpriority, n AS input_rows, i::INT AS ahead, lpad((x // 12)::VARCHAR, 4, '0') || '-' || lpad((x % 12 + 1)::VARCHAR, 2, '0') AS label, round(ym + slope * (x - xm), 2) AS value
FROM (SELECT f.*, i, (xl + i)::BIGINT AS x FROM (SELECT o_orderpriority, count(*) AS n, regr_slope(revenue, x) AS slope, avg(x) AS xm, avg(revenue) AS ym, max(x) AS xl FROM marks GROUP BY 1) f, (SELECT unnest([1, 2, 3]) AS i))""",
    f"monthly AS ({_MONTHLY})", "marks AS (SELECT *, CAST(substr(month, 1, 4) AS INT) * 12 + CAST(substr(month, 6, 2) AS INT) - 1 AS x FROM monthly)"))
def forecast_months(spark, d):
    orders = t.load(spark, d, "orders")
    monthly = orders.groupBy("o_orderpriority", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("revenue")
    )
    return s.forecast(monthly, ["o_orderpriority"], "month", "revenue", "month", slice_col=F.substring("month", 1, 4))


@query("forecast_days", over_audit("""
SELECT agent_id, n AS input_rows, i::INT AS ahead, strftime(DATE '1970-01-01' + (xl + i * step)::INT, '%Y-%m-%d') AS label, round(ym + slope * (xl + i * step - xm), 2) AS value
FROM (SELECT f.*, (SELECT list_sort(list(gap)) FROM (SELECT x - lag(x) OVER (ORDER BY x) AS gap FROM marks m WHERE m.agent_id = f.agent_id) WHERE gap IS NOT NULL)[(f.n - 1) // 2 + 1] AS step
 FROM (SELECT agent_id, count(*) AS n, regr_slope(rows, x) AS slope, avg(x) AS xm, avg(rows) AS ym, max(x) AS xl FROM marks GROUP BY 1 HAVING count(*) >= 3) f), (SELECT unnest([1, 2, 3]) AS i)""",
    "marks AS (SELECT agent_id, (ts::DATE - DATE '1970-01-01') AS x, count(*) AS rows FROM audit_log WHERE decision = 'deny' GROUP BY 1, 2)"))
def forecast_days(spark, d):
    daily = t.audit_log(spark, d).filter(F.col("decision") == "deny").groupBy("agent_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("rows"))
    return s.forecast(daily, ["agent_id"], "day", "rows", "day", slice_col=F.trunc("day", "month"))
