"""DuckDB SQL with the results of the queries that SQL can express, over the same tables."""

from __future__ import annotations

WORDS = r"'[^\x20\x09-\x0D]+'"

SUBSTRING = rf"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS key FROM docs, unnest(range(1, len(w) - 11)) AS u(i)),
firsts AS (SELECT key, min(doc_id) AS first FROM windows GROUP BY key),
gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM windows JOIN firsts USING (key), range(13) AS r(k) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM docs),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""

SUFFIX = r"""
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (
  SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS key FROM docs, unnest(range(0, CAST(length(h) / 2 AS BIGINT) - 99)) AS u(i)),
numbered AS (SELECT doc_id, i, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS k FROM strings),
hits AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM numbered WHERE k > 1),
spans AS (
  SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM hits),
runs AS (SELECT doc_id, span, min(i) AS lo, max(i) + 100 AS hi FROM spans GROUP BY ALL),
gaps AS (
  SELECT doc_id, lo, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS start, lo AS stop FROM runs
  UNION ALL SELECT doc_id, 1000000000, max(hi), 1000000000 FROM runs GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * start + 1, 2 * (stop - start)), '' ORDER BY lo) AS kept FROM gaps JOIN docs USING (doc_id) GROUP BY doc_id),
counted AS (SELECT doc_id, sum(hi - lo) AS removed, count(*) AS n FROM runs GROUP BY doc_id)
SELECT doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans,
  sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id) LEFT JOIN counted USING (doc_id)
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINES = rf"""
WITH lines AS (
  SELECT doc_id, unnest(s) AS line, unnest(range(len(s))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
keyed AS (
  SELECT *, {_LOWER.format(r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")} AS key FROM lines),
firsts AS (SELECT key, min(doc_id) AS first FROM keyed GROUP BY key),
judged AS (SELECT doc_id, i, line, length(key) >= 10 AND first < doc_id AS dropped FROM keyed JOIN firsts USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

NEAR = rf"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {WORDS}) AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS s FROM docs, unnest(range(1, greatest(len(w) - 3, 2))) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * pairs.n >= 75 * (x.n + y.n - pairs.n)),
reach AS (
  SELECT a AS node, b AS other FROM links UNION SELECT node, b FROM reach JOIN links ON other = a),
least AS (SELECT node, min(other) AS m FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id <= coalesce(m, d.doc_id) AS kept
FROM docs d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least ON node = d.doc_id
"""

_PARTS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

LEAKS = rf"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_PARTS}) AS w FROM benchmark),
sides AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS key
  FROM items, unnest(range(1, greatest(len(w) - 8, 2))) AS u(i) WHERE len(w) > 0),
docs AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_PARTS}) AS w FROM documents),
found AS (
  SELECT doc_id, i, s.size, item_id FROM (
    SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS key
    FROM docs, (SELECT DISTINCT size FROM sides), unnest(range(1, len(w) - size + 2)) AS u(i)) JOIN sides s USING (size, key)),
hits AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM found, range(10) AS r(k) WHERE k < size GROUP BY doc_id),
leaked AS (
  SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hits.n, 0) AS n_hit, coalesce(leaked.n, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN leaked USING (doc_id)
"""
