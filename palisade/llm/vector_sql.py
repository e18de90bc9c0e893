"""DuckDB SQL with the results of the vector queries: all distances of every round, without bounds or trees.

Components are whole numbers in doubles, so products and sums of the given tables are exact.
"""

from __future__ import annotations

_FINITE = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _cells(scale: int) -> str:
    return f"list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE)))"


def _squared(a: str, b: str) -> str:
    return f"list_dot_product({a}, {a}) - 2 * list_dot_product({a}, {b}) + list_dot_product({b}, {b})"


def centroids(clusters: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64) -> str:
    parts = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, {_cells(scale)} AS v FROM embeddings WHERE len(embedding) = {dims} AND {_FINITE})",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (
          SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM kept ORDER BY h, v LIMIT {clusters}))""",
    ]
    for k in range(rounds + 1):
        nearest = f"SELECT r, min({{'d': {_squared('kept.v', f'c{k}.v')}, 'c': c{k}.c}}) AS best FROM kept, c{k} GROUP BY r"
        parts.append(f"a{k} AS MATERIALIZED ({nearest})")
        if k < rounds:
            parts += [
                f"m{k} AS (SELECT best.c AS c, i, floor(sum(v[i]) / count(*)) AS x FROM a{k} JOIN kept USING (r), range(1, {dims + 1}) AS u(i) GROUP BY ALL)",
                f"n{k} AS (SELECT c, list(x ORDER BY i) AS v FROM m{k} GROUP BY c)",
                f"c{k + 1} AS MATERIALIZED (SELECT c, coalesce(n{k}.v, c{k}.v) AS v FROM c{k} LEFT JOIN n{k} USING (c))",
            ]
    return f"""
WITH {", ".join(parts)}
SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance,
  CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c{rounds}.v, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN c{rounds} ON c{rounds}.c = best.c
"""


def codes(positions: int = 16, entries: int = 64, rounds: int = 2, dims: int = 64, scale: int = 256) -> str:
    width = dims // positions
    parts = [
        f"kept AS (SELECT row_number() OVER () AS r, vec_id, label, {_cells(scale)} AS v FROM embeddings WHERE embedding IS NOT NULL AND {_FINITE})",
        f"""parts AS MATERIALIZED (SELECT r, p, v[p * {width} + 1:p * {width} + {width}] AS v FROM kept, range({positions}) AS u(p))""",
        f"""c0 AS MATERIALIZED (SELECT p, e, parts.v FROM parts JOIN (
          SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM kept ORDER BY vec_id NULLS LAST, v LIMIT {entries}) USING (r))""",
    ]
    for k in range(rounds + 1):
        nearest = f"SELECT r, p, min({{'d': {_squared('parts.v', f'c{k}.v')}, 'e': c{k}.e}}) AS best FROM parts JOIN c{k} USING (p) GROUP BY r, p"
        parts.append(f"a{k} AS MATERIALIZED ({nearest})")
        if k < rounds:
            parts += [
                f"""m{k} AS (SELECT p, best.e AS e, i, floor(sum(v[i]) / count(*)) AS x
                  FROM a{k} JOIN parts USING (r, p), range(1, {width + 1}) AS u(i) GROUP BY ALL)""",
                f"n{k} AS (SELECT p, e, list(x ORDER BY i) AS v FROM m{k} GROUP BY p, e)",
                f"c{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(n{k}.v, c{k}.v) AS v FROM c{k} LEFT JOIN n{k} USING (p, e))",
            ]
    last = f"c{rounds}"
    return f"""
WITH {", ".join(parts)},
books AS (
  SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: CAST(x AS BIGINT)), ','), ',' ORDER BY p, e)) AS digest FROM {last}),
coded AS (
  SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256
FROM coded JOIN kept USING (r), books
"""


CENTROIDS = centroids()
CODES = codes()
