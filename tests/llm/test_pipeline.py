"""Registered queries against their SQL, and the pipeline against brute force, stage by stage."""

from __future__ import annotations

import brute
import oracle
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palisade.llm import ctw, language, pii
from palisade.llm.registry import CHECK_SQL, QUERIES


@pytest.fixture(scope="module")
def connection(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(CHECK_SQL))
def test_query_matches_its_sql(spark, sf_dir, connection, name):
    df = QUERIES[name](spark, sf_dir)
    assert oracle.compare(df, connection, CHECK_SQL[name]) == []
    assert oracle.type_gaps(df, connection, CHECK_SQL[name]) == []


def test_every_operator_has_one_query():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def test_personal_data_query(spark, sf_dir, documents):
    got = {r.doc_id: r for r in pii.op7_pii(spark, sf_dir).collect()}
    for i, t in documents:
        base = brute.personal(t)
        assert got[i].base_sha256 == brute.sha(base)
        assert set(base.split(",")) <= set(got[i].spans.split(","))
        assert got[i].n_email + got[i].n_ip + got[i].n_card + got[i].n_phone == len([x for x in base.split(",") if x])


def test_score_query(spark, sf_dir, documents):
    short = [(i, t) for i, t in documents if i % 7 == 0 and len(t or "") < 900]
    frame = spark.createDataFrame(short, "doc_id long, text string")
    got = {r.doc_id: r for r in ctw.score_texts(frame, blocks=2).collect()}
    for i, (_, n, known, total, base, score) in brute.context_tree(short).items():
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (n, known, total)
        assert got[i].base_score == pytest.approx(base) and got[i].score == pytest.approx(score)
    assert ctw.op8_lm_score(spark, sf_dir).count() == len(documents)


def test_pipeline_stages(spark, sf_dir):
    """Each stage on its own input, as it is written and read between them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    odd = docs.limit(1).select(F.lit(-1).cast("long").alias("doc_id"), F.lit("12 34 !").alias("text"), "lang", "source", "n_chars")
    docs = docs.unionByName(odd.select(*columns))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, sf_dir)
        rows = out.collect()
        after = {r.doc_id: r.text for r in rows}
        if name == "language":
            judged = language.predict(docs, language.fit(docs)).filter("lang_pred <> 'und'")
            assert set(after) == {r.doc_id for r in judged.select("doc_id").collect()} and -1 not in after
        elif name == "lines":
            assert after == {i: t for i, _, _, t in brute.lines(before)}
            assert all(r.n_chars == len(r.text) for r in rows)
        elif name == "near_duplicates":
            assert set(after) == {i for i, (_, c) in brute.near(before).items() if i == c}
        elif name == "leaks":
            assert set(after) == {i for i, _, hit, _ in brute.leaks(before, items) if not hit}
        else:
            assert set(after) == {i for i, _ in before}
            assert {r.doc_id: r.size for r in rows} == {i: len(brute.WORD.findall(t or "")) for i, t in before}
            assert all(0 <= r.taken <= 2 * r.size for r in rows)
        assert out.columns[: len(columns)] == columns and (name == "mix" or out.columns == columns)
        docs = spark.createDataFrame(rows, out.schema).select(*columns)


def test_run_ends_with_the_mix(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    sums = out.groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken"))
    assert all(abs(r.target - r.taken) <= 1 for r in sums.collect())
    assert corpus_pipeline.ORACLE_SQL is None
