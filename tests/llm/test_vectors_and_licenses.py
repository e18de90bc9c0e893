"""Clustering, vector codes and license scans against brute force: nulls, ties, repeats, odd lengths, empty tables."""

from __future__ import annotations

import math
import random

import brute
import duckdb
import numpy as np
import oracle
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palisade.llm import centroids, codebooks, licenses, vector_sql, vectors

VECTORS = "vec_id long, embedding array<float>, label int"


def vector_rows(n=150, dims=64, seed=3):
    """Vectors in loose groups, and among them repeats, ties, nulls and rows that cannot be kept."""
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 0.3) for _ in range(dims)] for _ in range(9)]
    rows = [(i * 7 % 1009, [rng.gauss(m, 0.1) for m in middles[i % 9]], None if i % 5 == 0 else i % 3) for i in range(n)]
    rows += [(3000 + i, rows[4][1], 1) for i in range(30)] + [(5, rows[9][1], 2), (5, rows[9][1], 2), (5, rows[10][1], None)]
    rows += [(None, rows[11][1], 0), (None, rows[12][1], None), (-4, [-0.001] * dims, 7), (2**62, [30.0] * dims, 7)]
    odd = [None, [], [0.5] * 10, [0.5] * 48, [None] + [0.1] * 63, [float("nan")] + [0.1] * 63, [0.1] * 63 + [float("inf")]]
    return rows + [(9000 + i, cells, 1) for i, cells in enumerate(odd)]


def vector_table(spark, rows, extra=True):
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    clash = ("cells", "n", "dims", "width", "order", "keys", "cluster", "code", "error", "distance", "__n", "__label")
    return df.withColumns({c: F.lit("mine") for c in clash}) if extra else df


def as_floats(rows):
    """The same rows with components as a column of floats holds them."""
    return [(r[0], *r[2:], None if r[1] is None else [None if x is None else float(np.float32(x)) for x in r[1]]) for r in rows]


@pytest.fixture(scope="module")
def rows():
    return vector_rows()


@pytest.mark.parametrize("block_rows", [8192, 20])
def test_centroid_clusters(spark, rows, monkeypatch, block_rows):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", block_rows)
    members, found = centroids.centroid_clusters(vector_table(spark, rows))
    expected, centres = brute.centroids([(i, cells) for i, _, cells in as_floats(rows)])
    assert sorted(map(tuple, members.collect()), key=repr) == sorted(expected, key=repr)
    by = {r.cluster: r for r in found.collect()}
    assert [by[c].centroid for c in range(16)] == centres
    sums = {c: sum(d for _, at, d in expected if at == c) for c in by}
    assert all(by[c].cluster_inertia == sums[c] and by[c].inertia == sum(sums.values()) for c in by)
    # The first round compares all vectors; once the centroids settle, only those whose gap has run out.
    popped = by[0].popped
    assert popped[0] == len(expected) and popped[-1] < len(expected) / 2


def test_few_vectors_and_few_clusters(spark):
    rows = [(i, [0.1 * i] * 64, 0) for i in range(5)]
    for clusters in (1, 3, 16):
        members, found = centroids.centroid_clusters(vector_table(spark, rows), clusters=clusters)
        expected, centres = brute.centroids([(i, c) for i, _, c in as_floats(rows)], clusters=clusters)
        assert sorted(map(tuple, members.collect())) == sorted(expected)
        assert [r.centroid for r in found.orderBy("cluster").collect()] == centres


def test_large_components_are_cut(spark):
    rows = [(1, [1e30] * 64, 0), (2, [-1e30] * 64, 0), (3, [0.0] * 64, 0)]
    members, _ = centroids.centroid_clusters(vector_table(spark, rows), clusters=1, rounds=0)
    assert {d for _, _, d in map(tuple, members.collect())} <= {0, 64 * 2**54, 64 * 2**56}


def test_heaps_pop_only_what_has_expired():
    rng = np.random.default_rng(5)
    points = rng.integers(-50, 50, (400, 8))
    centres = points[:6].copy()
    heaps, _, n = centroids.step(points, None, centres, np.zeros(6))
    assert n == 400
    # Centroids that do not move: only vectors as near to another centroid as to their own are looked at again.
    _, change, n = centroids.step(points, heaps, centres, np.zeros(6))
    squares = np.sort(vectors.square_distances(points, centres), axis=1)
    assert n == (squares[:, 0] == squares[:, 1]).sum() and not change.any()


@given(st.integers(0, 2**32 - 1), st.integers(1, 7), st.integers(1, 80), st.integers(1, 40))
@settings(max_examples=40, deadline=None)
def test_bounds_never_keep_a_wrong_cluster(seed, k, n, spread):
    rng = np.random.default_rng(seed)
    points, centres = rng.integers(-spread, spread + 1, (n, 3)), rng.integers(-spread, spread + 1, (k, 3))
    heaps, drift = None, np.zeros(k)
    for _ in range(5):
        heaps, _, _ = centroids.step(points, heaps, centres, drift)
        cluster = np.empty(n, dtype=int)
        cluster[heaps.rows] = heaps.clusters()
        assert (cluster == np.argmin(vectors.square_distances(points, centres), axis=1)).all()
        new = centres + rng.integers(-2, 3, centres.shape)
        moves = np.sqrt(np.square(new - centres).sum(axis=1)) * (1 + centroids.SLACK)
        drift = drift + moves + [max((m for j, m in enumerate(moves) if j != c), default=0.0) for c in range(k)]
        centres = new


@pytest.mark.parametrize("block_rows", [8192, 33])
def test_vector_codes(spark, rows, monkeypatch, block_rows):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", block_rows)
    coded, books = codebooks.compress(vector_table(spark, rows))
    expected, expected_books = brute.codes(as_floats(rows))
    assert books.tolist() == expected_books
    got = [(r.vec_id, r.label, bytes(r.code), r.error) for r in coded.collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_vector_codes_of_other_lengths(spark):
    rows = [(i, [0.01 * ((i * k) % 37) for k in range(48)], None) for i in range(40)] + [(900 + i, [0.2] * 64, 1) for i in range(9)]
    table = vector_table(spark, rows, extra=False).drop("label")
    coded, books = codebooks.compress(table, entries=5)
    expected, expected_books = brute.codes(as_floats(rows), entries=5)
    assert books.tolist() == expected_books and books.shape == (16, 5, 3)
    assert sorted((r.vec_id, r.label, bytes(r.code), r.error) for r in coded.collect()) == sorted(expected)


@given(st.integers(0, 2**32 - 1), st.integers(1, 70), st.integers(1, 300), st.sampled_from([1, 3, 40, 10**6]))
@settings(max_examples=60, deadline=None)
def test_dual_tree_finds_the_nearest_entry(seed, k, n, spread):
    rng = np.random.default_rng(seed)
    points, book = rng.integers(-spread, spread + 1, (n, 4)), rng.integers(-spread, spread + 1, (k, 4))
    order = codebooks.tree_order(points, codebooks.LEAF)
    tree, ((entries, names),) = codebooks.Tree.over(points[order], codebooks.LEAF), codebooks._entry_trees(book[None])
    done = codebooks.assign(tree, entries, names)
    best = np.square(points[:, None] - book[None]).sum(axis=2).argmin(axis=1)
    assert (done.code == best[order]).all()
    assert (done.counts == np.bincount(best, minlength=k)).all()
    assert (done.sums == vectors.sums_by(best, points, k)).all()


def test_dual_tree_assigns_whole_nodes():
    rng = np.random.default_rng(8)
    groups = np.repeat(rng.integers(-10_000, 10_000, (32, 4)), 100, axis=0)
    points = groups + rng.integers(-5, 6, groups.shape)
    tree = codebooks.Tree.over(points[codebooks.tree_order(points, 16)], 16)
    ((entries, names),) = codebooks._entry_trees(groups[::100][None])
    assert codebooks.assign(tree, entries, names).compared < 0.5 * len(points)


@pytest.mark.parametrize(("query", "sql"), [(centroids.op11_centroid_clusters, vector_sql.CENTROIDS), (codebooks.op13_vector_codes, vector_sql.CODES)])
def test_vector_queries_match_their_sql_on_hard_rows(spark, rows, tmp_path, query, sql):
    vector_table(spark, [r for r in rows if r[1] is None or len(r[1]) in (0, 64)], extra=False).write.parquet(f"{tmp_path}/embeddings.parquet")
    connection = duckdb.connect()
    if query is codebooks.op13_vector_codes:  # empty vectors cannot be cut; the SQL knows one length only
        connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet') WHERE len(embedding) = 64")
    else:
        connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert oracle.compare(query(spark, str(tmp_path)), connection, sql) == []


def test_empty_vector_tables(spark, tmp_path):
    for number, rows in enumerate(([], [(1, None, 1), (None, None, None)])):
        frame = vector_table(spark, rows)
        members, found = centroids.centroid_clusters(frame)
        assert members.count() == 0 and found.count() == 0
        coded, books = codebooks.compress(frame)
        assert coded.count() == 0 and books.shape == (16, 0, 1)
        frame.write.parquet(f"{tmp_path}/{number}/embeddings.parquet")
        for query in (centroids.op11_centroid_clusters, codebooks.op13_vector_codes):
            assert query(spark, f"{tmp_path}/{number}").count() == 0


def test_attach_spreads_hot_keys_and_matches_null(spark):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else ("hot" if i % 3 == 1 else f"k{i}")) for i in range(900)], "id long, key string")
    table = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("total"))
    got = {r.id: r.total for r in vectors.attach(rows, table, ["key"]).collect()}
    sums = {r.key: r.total for r in table.collect()}
    assert got == {r.id: sums[r.key] for r in rows.collect()}
    missing = vectors.attach(rows, table.filter("key = 'hot'"), ["key"])
    assert missing.filter("total IS NULL").count() == 600 and missing.count() == 900


MIT, APACHE = licenses.NOTICES[0].text, licenses.NOTICES[1].text


def license_rows():
    rng = random.Random(4)
    filler = lambda n: " ".join(rng.choice(["the", "of", "software", "license", "version", "blue", "sea", "2", "use", "été"]) for _ in range(n))
    edited = MIT.split()
    edited[20:20] = ["and", "really", "all"]
    del edited[40]
    rows = [
        (1, None), (2, ""), (3, filler(40)), (4, f"Copyright (c) 2020\n{MIT.upper()}."), (5, " ".join(edited)), (6, MIT + " " + filler(30) + " " + APACHE + " " + MIT),
        (7, "Released under the MIT License. Released under the MIT-License, CC BY-NC 4.0"), (8, "under the mit"), (9, "license under the mit license under the mit license"),
        (10, APACHE.replace("version 2", "version 3")), (11, "you may not use this file except in compliance with the license"), (12, " ".join(reversed(MIT.split()))),
        (13, "This work is licensed under the GNU General Public License, version 3."), (14, licenses.NOTICES[6].text), (15, licenses.NOTICES[7].text.replace(" ", "\n * ")),
        (16, filler(5000) + " " + licenses.NOTICES[2].text + " " + filler(5000)), (17, licenses.NOTICES[2].text), (17, licenses.NOTICES[2].text), (None, MIT), (None, None),
        (18, MIT[: len(MIT) // 4]), (19, "under the"), (20, "mit license"), (21, "日本 " * 50 + "cc by nc"),
    ]
    return rows + [(100 + i, filler(20) + rng.choice(["", " " + t.text]) + " " + filler(15)) for i in range(20) for t in (rng.choice(licenses.TEMPLATES),)]


def license_table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df.withColumns({c: F.lit("mine") for c in ("n_words", "places", "labels", "word", "n")})


def test_license_places(spark):
    rows = license_rows()
    got = licenses.scan_licenses(license_table(spark, rows)).collect()
    found = [(r.doc_id, r.n_words, sorted((p.template, p.start, p.end, round(p.score, 9)) for p in r.places)) for r in got]
    expected = [(i, n, [(t, a, b, round(s, 9)) for t, a, b, s in places]) for i, n, places in brute.licenses(rows, licenses.TEMPLATES)]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    labels = {r.doc_id: {p.label for p in r.places} for r in got}
    assert labels[4] == labels[5] == {"mit"} and labels[6] == {"mit", "apache-2"} and labels[13] == labels[14] == {"gpl-3"} and labels[15] == {"gpl-2"}
    assert not any(labels[i] for i in (1, 2, 3, 8, 12, 18, 19, 20))


def test_license_query(spark, tmp_path):
    rows = license_rows()
    license_table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = licenses.op12_license_scan(spark, str(tmp_path))
    expected = []
    for i, n, places in brute.licenses(rows, licenses.TEMPLATES):
        base = [p for p in places if not licenses.TEMPLATES[p[0]].phrases]
        listed = lambda found: ",".join(sorted({licenses.TEMPLATES[p[0]].label for p in found}))
        starts = [p[1] for p in base]
        expected.append((i, n, len(base), min(starts, default=None), max(starts, default=None), listed(base), listed(places), round(max((p[3] for p in places), default=0.0), 9)))
    found = [(*r[:-1], round(r[-1], 9)) for r in map(tuple, got.collect())]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    assert got.schema.simpleString() == (
        "struct<doc_id:bigint,n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:string,labels:string,score:double>"
    )


def test_license_scan_of_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.scan_licenses(empty).count() == 0
    nulls = spark.createDataFrame([(None, None)] * 3, "doc_id long, text string")
    assert [tuple(r) for r in licenses.scan_licenses(nulls).collect()] == [(None, 0, [])] * 3


def test_rare_words_come_from_the_corpus():
    words = licenses.TEMPLATES[3].text.split()
    weights = licenses.weigh(licenses.vocabulary(licenses.TEMPLATES), {"permission": 50, "sublicense": 0}, 100)
    chosen = [words[p] for p in licenses.rare_positions(words, weights, 8)]
    assert "permission" not in chosen and len(chosen) == 8 and math.isclose(weights["sublicense"], 1 + math.log(101))
