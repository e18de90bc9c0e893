"""Work that must grow with the input and no faster: what a step hands on, not how long it takes."""

from __future__ import annotations

import datetime as dt
import json
import random

import pyarrow as pa
from pyspark.sql import functions as F

from palisade.functions import within
from palisade.operators import chain as c
from palisade.operators import discover
from palisade.operators import policy as p
from palisade.operators import recursion
from palisade.operators import redact
from palisade.operators import retrieval as r
from palisade.plans.catalog import QUERIES


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_replay_folds_policies_of_one_scope_before_probes_meet_them(spark):
    columns = "tenant_id string, agent_id string, datasource_id string, object_type string, object_name string, columns string, row_filter string, action string"
    many = [("t", "a", "d", "table", "s.x", None, None, "allow")] * 40 + [("t", "a", "d", "table", "s.*", None, None, "deny")] * 3
    before, after = spark.createDataFrame(many, columns), spark.createDataFrame(many[:40] + [("t", None, "d", "table", "s.x", None, None, "deny")], columns)
    probes = spark.createDataFrame([(i, "t", "a", "d", "s", "x" if i % 2 else "y") for i in range(4)], "probe_id int, tenant_id string, agent_id string, datasource_id string, schema_name string, table_name string")
    out = p.policy_replay(before, after, probes)
    assert rows(out) == [(0, "deny", "deny"), (1, "deny", "candidate"), (2, "deny", "deny"), (3, "deny", "candidate")]
    assert sum("object_name" in line for line in optimized(out).splitlines() if "Aggregate [" in line) == 2


def test_a_name_is_split_once(spark):
    names = spark.createDataFrame([(1, "userPhoneNumber"), (2, "x9"), (3, None), (4, "price_date"), (5, "full name")], "column_id int, column_name string")
    out = discover.classify_columns(names)
    assert rows(out.select("column_id", "category", "strength", "signal")) == [
        (1, "phone", "strong", "column_name_strong_phone"), (4, "date", "strong", "column_name_strong_date"), (5, "generic", "strong", "column_name_strong_generic")]
    assert optimized(out).count("regexp_replace(regexp_replace(") == 1


def test_users_with_the_same_roles_share_their_closure(spark, monkeypatch):
    roles = spark.createDataFrame([(f"r{i}",) for i in range(5)], "role_id string")
    parents = spark.createDataFrame([(f"r{i}", f"r{i + 1}") for i in range(4)], "role_id string, parent_id string")
    permissions = spark.createDataFrame([("r4", "p4"), ("r1", "p1"), ("r1", None)], "role_id string, permission string")
    held = [(i, r) for i in range(30) for r in ("r0", "r2")] + [(30, "r0"), (31, "ghost"), (32, None), (None, "r1"), (None, "ghost")]
    seeds, inner = [], recursion.recurse
    monkeypatch.setattr(p, "recurse", lambda seed, *a, **k: seeds.append(seed.distinct().count()) or inner(seed, *a, **k))
    got = rows(p.effective_permissions(roles, parents, permissions, spark.createDataFrame(held * 2, "user_id int, role_id string")))
    users = [*range(31), None]
    want = [(u, x, False) for u in users for x in ("p4", "p1", None)] + [(u, None, True) for u in (31, 32, None)]
    assert got == sorted(want, key=repr)
    assert seeds == [2 + 1 + 1 + 1 + 2]


def test_a_long_chain_of_checkpoints_is_linked_in_blocks(spark, monkeypatch):
    base = dt.datetime(2024, 1, 1)
    frame = spark.range(1, 41).select(
        F.lit("t").alias("tenant_id"), F.lit("c").alias("chain_id"), F.col("id").alias("ordinal"), F.sha2(F.col("id").cast("string"), 256).alias("archive_sha256"),
        F.lit(base).cast("timestamp_ntz").alias("created_at"), F.lit(base).cast("timestamp_ntz").alias("signed_at"), F.col("id").alias("head_seq"), F.lit("h").alias("head_hash"),
    )
    whole, blocks = rows(c.link_checkpoints(frame)), rows(c.link_checkpoints(frame, max_block_rows=9))
    assert whole == blocks and len(whole) == 40
    # What one task reads does not grow with the chain: about 120 bytes a row of a block.
    assert c.link_checkpoints.__defaults__[0] * 120 < 300_000_000


def test_copies_of_questions_and_examples_do_not_multiply(spark, monkeypatch):
    texts = ["show the total", "total", " Total ", "the", "show the total now", ""]
    asked = [(i, texts[i % 6]) for i in range(48)] + [(3, "other the"), (None, "the")]
    known = [(1000 - i, texts[i % 5] + ("!" * 40 if i % 7 == 0 else ""), "d" * (1500 if i % 3 == 0 else 4090 if i % 11 == 0 else 5), i % 13 != 0) for i in range(900)]
    met, inner = [], r._first_hits
    monkeypatch.setattr(r, "_first_hits", lambda pairs, *a: met.append(pairs.count()) or inner(pairs, *a))
    questions = spark.createDataFrame(asked * 2, "question_id int, text string")
    examples = spark.createDataFrame(known * 2, "example_id int, question string, description string, enabled boolean")
    got = rows(r.match_examples(questions, examples).filter("question_id IS NOT NULL").select("question_id", "rank", "example_id"))
    want, every = [], 0
    for q in {i for i, _ in asked if i is not None}:
        own = [x.strip().lower() for i, x in asked if i == q and x.strip()]
        hits, used, taken = set(), 2, []
        for e, question, text, enabled in known:
            sample = question.strip().lower()
            if enabled and sample and any(sample in x or x in sample for x in own):
                hits.add((e, len(json.dumps({"question": question, "description": text}, separators=(",", ":")))))
        every += len(hits)
        for e, size in sorted(hits):
            if used + size + 1 <= r.MAX_HINT_BYTES and len(taken) < r.MAX_EXAMPLES:
                used, taken = used + size + 1, [*taken, e]
        want += [(q, at, e) for at, e in enumerate(taken, start=1)]
    assert got == sorted(want, key=repr)
    # Of each size a few, though hundreds of examples match a question.
    assert met[0] * 4 < every


def test_a_log_of_outputs_is_not_dealt_by_origin_or_name(spark):
    columns = "query_id int, output_index int, result_name string, arm_index int, kind string, operation string, status string, dep_schema string, dep_table string, dep_column string, dep_role string, possible_relations array<struct<schema_name:string,table_name:string>>"
    log = [(i, 0, "total", 0, "direct", "", "resolved", "s", "t", "Phone", "value", [("s", "u")]) for i in range(3000)]
    log += [(i, 1, "phone", 0, "constant", "", "source_free", None, None, None, None, [("s", "u")]) for i in range(3000)]
    log += [(i, 2, "x", 0, "opaque", "", "unresolved", None, None, None, None, [("s", "u" if i % 2 else "w")]) for i in range(3000)]
    rules = spark.createDataFrame([("r1", "", "", "phone", "phone", "mask"), ("r2", "s", "u", "mail", "email", "mask")], "rule_id string, schema_name string, table_name string, column_name string, sensitive_type string, algorithm string")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    try:
        out = redact.decide_output_masks(spark.createDataFrame(log, columns), rules)
        plan, got = out._jdf.queryExecution().executedPlan().toString(), rows(out)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    want = [(i, j, "rule", "r1", "phone", False) for i in range(3000) for j in (0, 1)] + [(i, 2, "block", None, "email", True) for i in range(1, 3000, 2)]
    assert got == sorted(want, key=repr)
    # A few settled values meet the log where it lies; a hash of them would put most of it into a few tasks.
    dealt = [line for line in plan.splitlines() if "hashpartitioning(" in line]
    assert dealt and all("query_id" in line and "output_index" in line for line in dealt)


def test_a_keyword_of_many_questions_does_not_fill_a_task(spark, monkeypatch):
    monkeypatch.setattr(r, "PAIRS_PER_TASK", 2000, raising=False)
    tables = spark.createDataFrame([(i, f"ring_{i}", "") for i in range(2000)] + [(5000, "Gear", None), (5000, "gear", "a gear"), (None, "ring", "")], "table_id bigint, name string, comment string")
    fields = spark.createDataFrame([(5000, "gear_no", "Gear"), (None, "ring", "ring")], "table_id bigint, field_name string, comment string")
    asked = spark.createDataFrame([(q, "Ring ") for q in range(30)] + [(30, "gear"), (30, ""), (None, "gear"), (None, "none")], "question_id bigint, keyword string")
    out = r.keyword_scores(tables, fields, asked)
    placed = out.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(x["count"] for x in placed) == 30 * 2000 + 1 and max(x["count"] for x in placed) < 4000
    assert rows(out) == sorted([(q, i, 0.38) for q in range(30) for i in range(2000)] + [(30, 5000, 1.0)], key=repr)
    # Questions with the same keywords share a ranking; a question without an id has its own.
    want = [(q, i, 0.38, i + 1) for q in range(30) for i in range(20)] + [(30, 5000, 1.0, 1)]
    best = r.best_tables(tables, fields, asked).select("question_id", "table_id", "score", "rank")
    assert rows(best.filter("question_id IS NOT NULL")) == sorted(want, key=repr)
    assert rows(best.filter("question_id IS NULL").select("table_id", "score")) == [(5000, 1.0)]


def test_every_table_that_keywords_touch_is_scored(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(r, "PAIRS_PER_TASK", 500)
    d, parts = str(tmp_path), 90
    spark.range(parts).select(
        F.col("id").alias("p_partkey"), F.when(F.col("id") % 3 == 0, "small ring").otherwise("large gizmo").alias("p_name"), F.lit("Brand#1").alias("p_brand"),
        F.lit("PROMO TIN").alias("p_type"), F.lit(7).alias("p_size"),
    ).coalesce(1).write.parquet(f"{d}/part.parquet")
    spark.range(20).select((F.col("id") * 35).alias("conv_id"), F.lit("user").alias("role"), F.when(F.col("id") < 18, 0).alias("turn"), F.lit("a ring").alias("text")).coalesce(1).write.parquet(f"{d}/conversations.parquet")
    # Questions with an id ask for ring and gizmo, of which each table's name holds one; those without ask for promo.
    out = QUERIES["keyword_scores"](spark, d)
    got = rows(out.groupBy("question_id").agg(F.count(F.lit(1)).alias("tables"), F.countDistinct("table_id").alias("distinct")))
    assert got == sorted([(i * 35000, parts, parts) for i in range(18)] + [(None, parts, parts)], key=repr)
    assert {x["score"] for x in out.filter("question_id IS NOT NULL").select("score").distinct().collect()} == {0.16, 0.19}
    tables, fields = spark.createDataFrame([(i, "ring", "") for i in range(50)], "table_id bigint, name string, comment string"), spark.createDataFrame([], "table_id bigint, field_name string, comment string")
    asked = spark.createDataFrame([(1, "ring"), (None, "ring"), (2, "none")], "question_id bigint, keyword string")
    assert rows(r.keyword_scores(tables, fields, asked)) == sorted([(1, i, 1.0) for i in range(50)], key=repr)
    assert rows(r.keyword_scores(tables, fields, asked, unnamed=True)) == sorted([(q, i, 1.0) for q in (1, None) for i in range(50)], key=repr)


def test_phrases_are_found_by_their_windows(monkeypatch):
    monkeypatch.setattr(within, "BYTES_AT_ONCE", 64)
    monkeypatch.setattr(within, "PAIRS_AT_ONCE", 5)
    draw = random.Random(3)
    texts = ["".join(draw.choices("aab\u00e9", k=draw.randint(1, 90))) for _ in range(60)] + ["a" * 70, "b", "\u00e9", "\u20ac uro"]
    phrases = sorted({x[i : i + n] for x in texts for n in (1, 2, 3, 4, 5, 8, 9, 16, 17, 31, 64, 65) for i in range(0, len(x) - n + 1, 7)} | {"ba" * n for n in range(1, 30)} | {"x", "a" * 91})
    rows_, hashed = pa.array(phrases), next(within._hashed(iter([pa.RecordBatch.from_arrays([pa.array(phrases), pa.array(range(len(phrases)))], names=["text", "own"])])))
    start, end, size = (hashed.column(k).to_numpy() for k in (1, 2, 3))
    assert size.tolist() == [len(x.encode()) for x in phrases]
    found = within._Phrases(start.view("uint64"), end.view("uint64"), size)
    got = []
    for data, sizes, first in within._pieces(pa.array(["skipped", *texts])[1:]):
        got += [(int(t) + first, rows_[int(k)].as_py()) for t, k in zip(*found.find(data, sizes))]
    assert sorted(got) == sorted((i, x) for i, text in enumerate(texts) for x in phrases if x in text)
    assert list(within._pieces(pa.array([], pa.string()))) == []


def test_first_items_keep_what_a_budget_can_reach(spark):
    draw = random.Random(5)
    lists = [[(i, draw.randint(1, 12)) for i in sorted(draw.sample(range(60), 25))] for _ in range(40)]
    frame = spark.createDataFrame([(k, [*x, x[-1]]) for k, x in enumerate(lists)], "k int, items array<struct<id:int,bytes:bigint>>")
    kept = {x["k"]: [tuple(y) for y in x["items"]] for x in frame.select("k", within.first_items(F.col("items"), 4).alias("items")).collect()}
    assert kept == {k: [x for i, x in enumerate(all_) if sum(y[1] <= x[1] for y in all_[:i]) < 4] for k, all_ in enumerate(lists)}
    listed = within._Listed(pa.array([[{"id": i, "bytes": n} for i, n in x] for x in [*lists, [(None, 3), (None, 3)]]]))
    draws = within.np.array(draw.choices(range(len(lists) + 1), k=500))
    many, rank = listed.of(draws)
    group, rank = within.first_of(within.np.repeat(draws, many), rank, listed.sizes, 4)
    got = list(zip(group.tolist(), listed.ids.take(pa.array(rank)).to_pylist(), listed.sizes[rank].tolist()))
    assert got == [(k, i, n) for k in sorted(kept) for i, n in kept[k]] + [(len(lists), None, 3)]


def test_examples_of_many_sizes_do_not_multiply(spark, monkeypatch):
    monkeypatch.setattr(within, "PHRASES_PER_SCAN", 30)
    words = [f"w{i}" for i in range(90)]
    asked = [(q, " ".join(words[q % 7 :])) for q in range(40)] + [(50, "w8"), (51, "w"), (None, "w89")]
    known = [(f"e{(i * 37) % 90:02d}", w.upper(), "d" * (1800 - 20 * i if i % 3 else 30 + i), True) for i, w in enumerate(words)] + [(None, "w1 w2", "d", True), ("e5", None, "d", True)]
    met, inner = [], r._first_hits
    monkeypatch.setattr(r, "_first_hits", lambda pairs, *a: met.append(pairs.count()) or inner(pairs, *a))
    out = r.match_examples(spark.createDataFrame(asked, "question_id int, text string"), spark.createDataFrame(known, "example_id string, question string, description string, enabled boolean"))
    want, every = [], 0
    for q, text in asked:
        hits = [(e or "", e, len(json.dumps({"question": w, "description": d}, separators=(",", ":")))) for e, w, d, _ in known if w and (w.lower() in text and q is not None or text in w.lower())]
        every, used, taken = every + len(hits), 2, []
        for _, e, size in sorted(hits, key=lambda x: x[0]):
            if used + size + 1 <= r.MAX_HINT_BYTES and len(taken) < r.MAX_EXAMPLES:
                used, taken = used + size + 1, [*taken, e]
        want += [(q, at, e) for at, e in enumerate(taken, start=1)]
    assert rows(out.select("question_id", "rank", "example_id")) == sorted(want, key=repr)
    # Each example has a size of its own, and still only a few of the many that match a question are handed on.
    assert met[0] * 4 < every
    nothing = spark.createDataFrame([], "example_id string, question string, description string, enabled boolean")
    assert r.match_examples(spark.createDataFrame(asked, "question_id int, text string"), nothing).count() == 0
    assert r.match_examples(spark.createDataFrame([], "question_id int, text string"), spark.createDataFrame(known, nothing.schema)).count() == 0
