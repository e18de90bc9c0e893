"""Every operator against brute force on small tables: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random

import brute
import duckdb
import oracle
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palisade.llm import check_sql, ctw, language, leaks, lines, mixing, near, pii, quality, substring, suffixes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows, extra=True):
    """Rows of (doc_id, text) as documents, with columns whose names the operators use themselves."""
    full = [(i, t, "en" if (i or 0) % 3 else None, None if (i or 0) % 5 == 4 else f"s{(i or 0) % 3}", len(t or "")) for i, t in rows]
    df = spark.createDataFrame(full, SCHEMA).repartition(3, "n_chars")
    clash = ("block", "bucket", "data", "rep", "band", "kept", "size", "n_words", "kept_text", "lang_pred", "host", "body")
    return df.withColumns({c: F.lit("mine") for c in clash}) if extra else df


def passages(seed=5, n=40):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Été", "ñandú", "x", "end.", "A", "tab", "ruin", "日本", "blue", "sea", "stone", "eleven", "twelve"]
    sentence = lambda k: " ".join(rng.choice(vocabulary) + rng.choice(["", "", "s", "1"]) for _ in range(k))
    shared = [sentence(40), sentence(18), sentence(90)]
    rows = []
    for i in range(n):
        parts = [sentence(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 2)):
            piece = rng.choice(shared).split(" ")
            lo = rng.randint(0, 5)
            parts += [" ".join(piece[lo : len(piece) - rng.randint(0, 5)]), sentence(rng.randint(0, 12))]
        rows.append((i * 3, rng.choice([" ", "\n", "\t\n"]).join(parts)))
    return rows


def hard(rows):
    """The rows, and nulls, empties, one long text, copies, and rows that repeat an id."""
    long = " ".join(f"w{k % 701}" for k in range(30_000))
    more = [(1, None), (2, ""), (4, " \n\t"), (5, long), (7, rows[3][1]), (8, rows[3][1]), (10, "a"), (None, rows[4][1]), (None, None)]
    return rows + more + [rows[5], rows[5], (rows[6][0], rows[7][1])]


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    return hard(passages())


@pytest.mark.parametrize(("blocks", "wide"), [(1, 64), (5, 64), (5, 2)])
def test_substring(spark, rows, blocks, wide):
    got = substring.remove_repeated_words(table(spark, rows), blocks=blocks, wide_blocks=wide)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_text") == sorted(brute.substring(rows), key=repr)


@pytest.mark.parametrize(("blocks", "wide"), [(1, 64), (5, 2)])
def test_suffix(spark, rows, blocks, wide):
    known = [r for r in rows if r[0] is not None]  # without an id the order between blocks is left open
    got = suffixes.remove_repeated_bytes(table(spark, known), blocks=blocks, wide_blocks=wide)
    found = sorted(((a, b, c, d, bytes(e)) for a, b, c, d, e in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()), key=repr)
    assert found == sorted(brute.suffix(known), key=repr)


@pytest.mark.parametrize(("blocks", "batches"), [(1, 1), (4, 5)])
def test_lines(spark, rows, blocks, batches):
    data = table(spark, rows)
    got = lines.remove_repeated_lines(data, blocks=blocks, batches=batches)
    assert rows_of(got, "doc_id", "n_lines", "n_dropped", "kept_text") == sorted(brute.lines(rows), key=repr)
    assert set(got.columns) == {*data.columns, "n_lines", "n_dropped"}


def test_line_index_compacts_its_runs(spark):
    rows = [(i, f"line number {i}\nshared line of all\nline number {i % 4} again") for i in range(12)]
    got = lines.remove_repeated_lines(table(spark, rows), batches=6, blocks=1)
    assert rows_of(got, "doc_id", "n_lines", "n_dropped", "kept_text") == sorted(brute.lines(rows), key=repr)


def near_rows():
    rng = random.Random(11)
    rows = []
    for group in range(6):
        base = [f"g{group}w{k}" for k in range(60)]
        for copy in range(9):
            words = list(base)
            for _ in range(copy % 6):
                words[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
            rows.append((group * 100 + copy, " ".join(words)))
    return rows + [(900, "one two"), (901, "One  two"), (902, "one two three"), (903, ""), (904, None), (905, " ".join(f"z{k}" for k in range(3000)))]


def test_near_duplicates(spark):
    rows = near_rows()
    expected = brute.near(rows)
    got = near.near_duplicates(table(spark, rows + [rows[0]])).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(i, n, c, i == c) for i, (n, c) in expected.items()}
    assert len(got) == len(rows) + 1


def test_near_duplicates_without_ids_and_with_shared_ids(spark):
    chain = [" ".join(f"w{k}" for k in range(60)), " ".join(f"q{k}" for k in range(60))]
    rows = [(1, chain[0]), (2, chain[1]), (2, chain[0]), (None, chain[1]), (None, "alone in the world today"), (9, None)]
    got = {(r.doc_id, r.component_id, r.kept) for r in near.near_duplicates(table(spark, rows)).collect()}
    assert got == {(1, 1, True), (2, 1, False), (None, 1, False), (None, None, True), (9, 9, True)}


def test_stage_keeps_one_row_of_each_group_without_ids_and_with_shared_ids(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(5, a), (None, a), (None, a + " end"), (3, b), (3, b), (None, c), (None, c), (None, c + " end"), (None, None), (None, ""), (7, None), (7, None), (8, b), (8, b)]
    got = corpus_pipeline.remove_near_duplicates(spark, table(spark, rows), "")
    assert got.columns == table(spark, rows).columns
    found = sorted(((r.doc_id, r.text) for r in got.collect()), key=repr)
    rest = [x for x in found if x[1] not in (c, c + " end")]
    assert rest == sorted([(5, a), (3, b), (None, None), (None, ""), (7, None)], key=repr)
    assert len(found) - len(rest) == 1
    plain = [(1, a), (2, a), (4, b)]
    assert rows_of(corpus_pipeline.remove_near_duplicates(spark, table(spark, plain), ""), "doc_id") == [(1,), (4,)]


def test_second_round_links_what_the_first_leader_misses(spark):
    """A group whose smallest id is far from the others, which are close to each other."""
    rng = random.Random(3)
    base = [f"b{k}" for k in range(200)]
    rows = []
    for i in range(14):
        words = list(base)
        for k in rng.sample(range(200), 9 if i == 0 else 2):
            words[k] = f"r{i}x{k}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r.component_id for r in near.near_duplicates(table(spark, rows)).collect()}
    assert got == {i: c for i, (_, c) in brute.near(rows).items()}


def test_second_round_joins_components(spark):
    """One bucket whose first member, and a copy of it, are unlike two others that are alike."""
    import pyarrow as pa

    base = [f"b{k}" for k in range(90)]
    unlike = base[:60] + [f"u{k}" for k in range(30)]
    texts = [unlike, unlike[:-1] + ["v"], base, ["w", *base[1:]], [*base[:-1], "y"]]
    rows = [(i + 1, " ".join(t)) for i, t in enumerate(texts)]
    sets, bounds = near.shingle_sets(pa.array([t for _, t in rows]))
    sketches = (near.Sketch(bands=1, rows=1, seed=s) for s in range(500))
    sketch = next(s for s in sketches if len(set(s.of_sets(sets, bounds[:-1])[:, 0].tolist())) == 1)
    got = {r.doc_id: r.component_id for r in near.near_duplicates(table(spark, rows), sketch=sketch).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3} == {i: c for i, (_, c) in brute.near(rows).items()}


def test_registers_follow_the_similarity():
    import numpy as np

    sketch = near.Sketch(bands=128, rows=8)
    rng = np.random.default_rng(0)
    both, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (6000, 1000, 1000))
    x, y = sketch.of_sets(np.concatenate([both, a, both, b]), np.array([0, 7000]))
    assert abs((x == y).mean() - 0.75) < 0.06
    union = sketch.of_sets(np.concatenate([both, a, b]), np.array([0]))[0]
    assert (np.maximum(x, y) == union).all()  # sketches merge


def benchmark(spark, rows):
    words = brute.PART.findall(rows[0][1] + " " + rows[3][1] + " " + rows[5][1])
    items = [(1, " ".join(words[:14])), (2, "-".join(words[5:30]).upper()), (3, " ".join(words[2:6])), (4, ""), (5, None), (6, " ".join(words[:14])), (10, "never seen words here")]
    return items, spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("side_bytes", [1 << 20, 60])
def test_leaks(spark, rows, side_bytes):
    items, frame = benchmark(spark, rows)
    got = leaks.find_leaks(table(spark, rows), frame, side_bytes)
    found = sorted(((r.doc_id, r.n_words, r.n_hit, list(r.leaked_items)) for r in got.collect()), key=repr)
    assert found == sorted(brute.leaks(rows, items), key=repr)
    assert any(f[2] for f in found)


def test_leaks_of_items_without_an_id(spark, tmp_path):
    """Their passages are hits like any other; they are one item of n_items and in no list. The check SQL agrees."""
    lost, named = (" ".join(f"{c}{k}" for k in range(15)) for c in "qz")
    items = [(None, lost), (7, named), (None, "two words")]
    rows = [(1, f"so {lost} it"), (2, "nothing here"), (3, f"{named} {lost}"), (4, named), (5, f"two words {lost}")]
    docs, frame = table(spark, rows, extra=False), spark.createDataFrame(items, "item_id long, text string")
    for side_bytes in (1 << 20, 20):
        got = leaks.find_leaks(docs, frame, side_bytes)
        found = {r.doc_id: (r.n_hit, list(r.leaked_items), r.n_items) for r in got.collect()}
        assert found == {1: (15, [], 1), 2: (0, [], 0), 3: (30, ["7"], 2), 4: (15, ["7"], 1), 5: (17, [], 1)}
    assert rows_of(leaks.drop_leaks(docs, frame), "doc_id") == [(2,)]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    frame.write.parquet(f"{tmp_path}/benchmark.parquet")
    connection = duckdb.connect()
    for name in ("documents", "benchmark"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    assert oracle.compare(leaks.op6_decontaminate(spark, str(tmp_path)), connection, check_sql.LEAKS) == []


def test_language_keeps_letters_without_labels_and_rejects_chance(spark):
    rows = [(1, "the cat and the dog"), (2, "ж"), (3, "12 !"), (4, None), (None, "words"), (6, "qqq"), (7, "жжжж the cat")]
    docs = table(spark, rows, extra=False)
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert rows_of(corpus_pipeline.identify_language(spark, unlabelled, ""), "doc_id") == rows_of(docs.filter("doc_id IS NULL OR doc_id IN (1, 2, 6, 7)"), "doc_id")
    model = language.fit(docs.filter("doc_id = 1"))
    assert model.languages == ("en",)
    assert rows_of(language.keep_identified(docs, model, above_chance=True), "doc_id") == [(1,), (7,)]


def test_language_of_hard_rows(spark):
    known = [(i, "the cat and the dog were there with them" if i % 2 else "der hund und die katze waren nicht mehr da") for i in range(60)]
    frame = spark.createDataFrame([(i, t, "en" if i % 2 else "de") for i, t in known], "doc_id long, text string, lang string")
    model = language.fit(frame)
    assert model.languages == ("de", "en")
    odd = [(1, None), (2, ""), (3, "123 !? \n"), (4, "with the dog"), (5, "und die katze"), (6, "ж"), (None, "the cat there"), (8, "the cat " * 50_000)]
    got = rows_of(language.predict(table(spark, odd), model), "doc_id", "lang_pred")
    assert got == sorted([(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "de"), (6, model.languages[model.usual]), (None, "en"), (8, "en")], key=repr)
    judged = language.predict(table(spark, odd), model)
    assert judged.filter("score < 0 OR score > 1").count() == 0
    assert rows_of(language.keep_identified(table(spark, odd, extra=False), model), "doc_id") == sorted([(4,), (5,), (6,), (None,), (8,)], key=repr)


def test_language_learns_from_rows_not_held_out(spark, sf_dir):
    judged = language.op4_language_id(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = judged.filter("held_out AND lang IS NOT NULL").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95
    assert judged.filter("held_out").count() == sum(brute.held_out(r.doc_id, 4, 2) for r in judged.select("doc_id").collect())


PERSONAL = [
    "a@b.c_d@e.f g@h..i x@y.z. é +1 (234) 567-8901 1.2.3.4.5.6.7.8 300.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 4111111111111112",
    ".a.b@c-d.e-f.g h%@i.j +12+3456789012-3 @x.y 😀a@b.cd😀  ab@c.d 12",
    "12345 " * 50 + "a." * 30 + "@b.c",
    "00255.1.2.3 0000000000255.1.1.1 +1234567890123456 +1",
    "@@ a@@b.c a@b@c.d @b.c 1 2 3 4 5 6 7 8 9 0 1 2 3 4 - 5",
    "card no 1234 5678 9012 3456 and 10.0.0.256",
    "x" * 40_000 + "@" + "y." * 9_000 + "z",
    "7 " * 20_000,
    None,
    "",
]


def test_personal_data(spark):
    rows = [(i, t) for i, t in enumerate(PERSONAL)] + [(None, PERSONAL[0]), (0, PERSONAL[0])]
    found = pii.find_personal_data(table(spark, rows)).select("doc_id", pii._listed(F.col("base_spans")), pii._listed(F.col("added_spans")))
    assert sorted(((r[0], r[1]) for r in found.collect()), key=repr) == sorted(((i, brute.personal(t)) for i, t in rows), key=repr)


def test_trees_learn_and_calibrate():
    cell = lambda at, digits, n, y: {**dict.fromkeys(pii.FEATURES, 0), "at_sign": at, "digits": digits, "n": n, "y": y, "cal_n": n // 4, "cal_y": y // 4}
    cells = [cell(1, 0, 400, 396), cell(0, 16, 200, 120), cell(0, 7, 400, 0), cell(0, 11, 80, 80)]
    model = pii.fit(cells, precision=0.95)
    above = [c for c in cells if model.value(c) >= model.threshold]
    assert [(c["at_sign"], c["digits"]) for c in above] == [(1, 0), (0, 11)]
    assert pii.fit([]).trees == ()


@pytest.mark.parametrize("depth", [2, 4, 7])
def test_context_tree(spark, depth):
    rows = [(i, t[:200]) for i, t in passages(9, 24)] + [(1, None), (2, ""), (4, "Zq#"), (5, "日本 " * 30)]
    got = {r.doc_id: r for r in ctw.score_texts(table(spark, rows), blocks=3, depth=depth).collect()}
    for i, (out, n, known, total, base, score) in brute.context_tree(rows, depth=depth).items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9, abs=1e-12)


def test_mix(spark):
    rows = [(i, "w " * (i % 7 * (30 if i % 3 == 0 else 1))) for i in range(60)] + [(None, "a b"), (None, None), (7, "x y z"), (7, "x y z")]
    got = mixing.mix_sources(table(spark, rows)).cache()
    assert got.filter("taken < 0 OR taken > 2 * size OR target > 2 * source_size").count() == 0
    by = got.groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken"), F.sum("size").alias("size"), F.first("source_size").alias("s"))
    for r in by.collect():
        assert abs(r.target - r.taken) <= 1 and r.size == r.s
    total = got.agg(F.sum("size")).first()[0]
    assert by.agg(F.sum("target")).first()[0] == pytest.approx(1.5 * total)
    again = mixing.mix_sources(table(spark, rows).repartition(7))
    assert rows_of(got, "doc_id", "size", "taken") == rows_of(again, "doc_id", "size", "taken")


def test_mixed_rows_hold_the_taken_words(spark):
    rows = [(i, "\n ".join(f"w{i}.{k}" for k in range(i % 9)) + " \t") for i in range(40)] + [(None, None), (7, "x y z")]
    mixed = mixing.mix_sources(table(spark, rows)).cache()
    got = mixing.mixed_rows(mixed).cache()
    sums = got.groupBy("source").agg(F.sum(mixing.word_count("text")).alias("n")).filter("n > 0")
    assert rows_of(sums, "source", "n") == rows_of(mixed.groupBy("source").agg(F.sum("taken").alias("n")).filter("n > 0"), "source", "n")
    assert got.filter(mixing.word_count("text") != F.col("taken")).count() == 0
    given = mixed.select("doc_id", "source", "text", "size", "taken").collect()
    expected = []
    for r in given:
        expected += [(r.doc_id, r.text)] * (r.taken // r.size if r.size else 0)
        if r.size and r.taken % r.size:
            expected.append((r.doc_id, r.text[: list(brute.WORD.finditer(r.text))[r.taken % r.size - 1].end()]))
    assert rows_of(got, "doc_id", "text") == sorted(expected, key=repr)
    fixed = spark.createDataFrame([("a  b\nc ", 3, 5), (" a b", 2, 1), ("z", 1, 0), ("", 0, 0)], "text string, size long, taken long")
    assert rows_of(mixing.mixed_rows(fixed), "text", "size", "taken", "copy") == sorted([("a  b\nc ", 3, 3, 1), ("a  b", 2, 2, 2), (" a", 1, 1, 1)], key=repr)


def test_quality_removes_lines_of_a_host(spark):
    menu = "home about contact help\nlog in to see more of this site today"
    body = lambda i: " ".join(f"word{i}x{k}" for k in range(12))
    rows = [(3 * i, f"{menu}\n{body(i)}\n" + ("" if i % 2 else " ".join(f"extra{i}y{k}" for k in range(30)))) for i in range(40)]
    rows += [(1, body(1)), (1, body(1)), (4, None), (7, ""), (10, "a b c"), (13, "same words all over again " * 12), (None, body(77))]
    copies = [(3 * i + 2, "one text that a host holds in many copies of it all") for i in range(40)]
    got = quality.judge(table(spark, rows + copies), line_docs=10, line_share=0.05).collect()
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[3 * i] == (i % 2 == 0) for i in range(40) if (3 * i) % 5 != 4)
    assert all(kept[i] for i, _ in copies) and kept[1] and kept[None]
    assert not any(kept[i] for i in (4, 7, 10, 13)) and len(got) == len(rows) + len(copies)


def test_boilerplate_lines_leave_the_texts(spark):
    menu = "home about contact help"
    body = lambda i: f"first of {i}\n\nsecond of {i}"
    rows = [(3 * i, f"{menu}\n{body(i)}\n  HOME about contact help") for i in range(40)]
    rows += [(1, body(1)), (1, body(1)), (4, None), (7, ""), (None, menu), (10, menu), (0, rows[0][1])]
    docs = table(spark, rows).withColumns({c: F.lit("mine") for c in ("gone", "place", "body", "line", "own")})
    got = quality.remove_boilerplate(docs, line_docs=10, line_share=0.05)
    assert got.columns == [*docs.columns, "n_removed_lines"] and got.filter("gone <> 'mine' OR own <> 'mine'").count() == 0
    hosts = {i: None if i % 5 == 4 else f"s{i % 3}" for i, _ in rows if i is not None}
    common = {h for h in set(hosts.values()) if sum(menu in (t or "") for t in {t for i, t in rows if i is not None and hosts[i] == h}) > 10}
    found = rows_of(got, "doc_id", "text", "n_removed_lines")
    expected = []
    for i, t in rows:
        lines = None if t is None else t.split("\n")
        keep = lines if lines is None or hosts.get(i, "s0") not in common else [x for x in lines if x.strip().lower() != menu]
        expected.append((i, None if keep is None else "\n".join(keep), 0 if keep is None else len(lines) - len(keep)))
    assert common and found == sorted(expected, key=repr)


EMPTY = {
    "boilerplate": lambda d, b: quality.remove_boilerplate(d),
    "substring": lambda d, b: substring.remove_repeated_words(d),
    "suffix": lambda d, b: suffixes.remove_repeated_bytes(d),
    "lines": lambda d, b: lines.remove_repeated_lines(d),
    "language": lambda d, b: language.predict(d, language.fit(d)),
    "near": lambda d, b: near.near_duplicates(d),
    "leaks": lambda d, b: leaks.find_leaks(d, b),
    "personal": lambda d, b: pii.find_personal_data(d),
    "context_tree": lambda d, b: ctw.score_texts(d),
    "mix": lambda d, b: mixing.mix_sources(d),
    "quality": lambda d, b: quality.judge(d),
}


CLASHES = ("__block", "__hits", "__letter", "__id", "n_words", "n_hit", "n_lines", "n_dropped", "kept_text", "lang_pred", "score", "own", "letter", "pred")


def test_stages_return_the_columns_they_were_given(spark, tmp_path):
    """Names that the operators use themselves come back with the caller's values; empty tables and null columns pass."""
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(i, f"the cat number {i} and the dog\nshared line of them all\nthe end of text {i}") for i in range(9)] + [(None, None), (20, "")]
    docs = table(spark, rows, extra=False).withColumns({c: F.concat(F.lit("mine"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in CLASHES})
    empty, nulls = docs.limit(0), docs.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema.fields])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns, name
        wrong = " OR ".join(f"`{c}` <> concat('mine', coalesce(cast(doc_id AS string), '-'))" for c in CLASHES)
        assert got.filter(wrong).count() == 0 and got.count() >= 8, name
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
        assert stage(spark, nulls, str(tmp_path)).columns == docs.columns, name
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, empty, str(tmp_path)).count() == 0 and last(spark, nulls, str(tmp_path)).count() == nulls.count()


@pytest.mark.parametrize("name", EMPTY)
def test_empty_tables_and_tables_of_nulls(spark, name):
    items = spark.createDataFrame([], "item_id long, text string")
    empty = spark.createDataFrame([], SCHEMA)
    assert EMPTY[name](empty, items).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 3, SCHEMA)
    assert EMPTY[name](nulls, items).count() == 3
