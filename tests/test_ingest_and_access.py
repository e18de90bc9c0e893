"""Text ingest, exports, row rules, governed views and small guards."""

from __future__ import annotations

import datetime as dt
import glob
import os
import random
import shutil
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from palisade.operators import audit
from palisade.operators import reconcile as rc
from palisade.operators import retrieval as r
from palisade.operators import rows as rw
from palisade.operators import series as s
from palisade.plans.governed import Access, assert_visible, governed, register
from palisade.session import scratch_path, shared_dir
from palisade.sources import export as ex
from palisade.sources import ingest as ig


def cells(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")


def typed(spark, values, kind):
    return [x[0] for x in cells(spark, values).orderBy("i").select(ig.typed_cell(F.col("v"), kind)).collect()]


def test_whole_numbers_round_halves_away_from_zero(spark):
    rng = random.Random(1)
    values = ["0.5", "-0.5", "1.5", "-2.5", "2.4999", "1e3", "15e-1", "-25e-1", "9223372036854775807", "9223372036854775807.4", "5e-1", "4e-1", "5e-2"]
    values += [f"{rng.choice(['', '-'])}{rng.randrange(10**rng.randint(1, 17))}.{rng.randrange(10**rng.randint(1, 6))}e{rng.randint(-6, 1)}" for _ in range(200)]
    expected = [int(Decimal(x).quantize(Decimal(1), rounding=ROUND_HALF_UP)) for x in values]
    assert typed(spark, values, "int") == expected
    assert typed(spark, ["", " ", "9223372036854775807.5", "1e30", ".5", "1.", "abc", "1e9999", None], "int") == [None] * 9


def test_floats_and_datetimes(spark):
    assert typed(spark, ["1.5", "-1e3", ".5", "1e400", "nan", "inf", "x"], "float") == [1.5, -1000.0, 0.5, None, None, None, None]
    got = typed(spark, ["2024-02-29", "2024-02-29 08:15", "2024-02-29 08:15:30.25", "2024-02-29T08:15:30+02:00", "2024-02-29T08:15:30Z", "2024-02-30", "2024-2-29", "0000-01-01"], "datetime")
    day = dt.datetime(2024, 2, 29)
    assert got == [day, day.replace(hour=8, minute=15), day.replace(hour=8, minute=15, second=30, microsecond=250000),
                   day.replace(hour=6, minute=15, second=30), day.replace(hour=8, minute=15, second=30), None, None, None]


def test_type_inference_ignores_blanks(spark):
    df = spark.createDataFrame([("1", "1", "", "9223372036854775808", "x"), (" +2 ", "2.5", None, "1", "1"), ("", " ", " ", "2", "2")], "a string, b string, c string, d string, e string")
    assert {x["field"]: x["type"] for x in ig.infer_types(df).collect()} == {"a": "int", "b": "float", "c": "string", "d": "float", "e": "string"}


def test_misfits_fail_or_are_set_aside(spark):
    df = cells(spark, ["1", "x", ""])
    with pytest.raises(Exception, match="do not fit"):
        ig.convert_types(df, {"v": "int"}).collect()
    good, bad = ig.convert_types(df, {"v": "int"}, on_error="quarantine")
    assert sorted(x["v"] is None for x in good.collect()) == [False, True]
    assert [(x["v"], x["bad_fields"]) for x in bad.collect()] == [("x", ["v"])]


def test_csv_problems_are_counted(spark):
    folder = scratch_path(spark, "raw")
    os.makedirs(folder.replace("file:", ""))
    with open(folder.replace("file:", "") + "/a.csv", "wb") as f:
        f.write(b'\xef\xbb\xbfid,name\n1,ok\n2\n3,a,b\n4,"x ""q"" y"\n5,bell\x07\n')
    df = ig.read_text_table(spark, folder)
    assert df.columns[:2] == ["id", "name"]
    counts = {x["violation"]: x["n"] for x in ig.ingest_quality(df).collect()}
    assert counts["row_width"] == 2 and counts["control_character"] == 1
    assert df.filter("id = '4'").first()["name"] == 'x "q" y'
    with open(folder.replace("file:", "") + "/b.csv", "wb") as f:
        f.write(b"id,name\n1,\xff\xfe\n2,a\x00b\n")
    report = ig.encoding_report(spark, folder).first()
    assert report["invalid_utf8"] == 1 and report["with_nul"] == 1


def test_header_rules():
    names = ["ok", "", " x", "y" * 64, "OK", "a\tb"]
    assert {p for p, _ in ig.header_problems(names)} == {"header_blank_or_untrimmed", "header_too_long", "header_control_character", "header_repeated"}


def test_formula_cells_are_neutralised(spark):
    values = ["=1", " +1", "　@x", "＝1", "\tx", "a=1", "-", "", None, "\n", " a\t"]
    got = [x[0] for x in cells(spark, values).orderBy("i").select(ex.sanitized("v")).collect()]
    assert got == ["'=1", "' +1", "'　@x", "'＝1", "'\tx", "a=1", "'-", "", None, "'\n", " a\t"]


def test_exports_are_never_cut(spark):
    with pytest.raises(ex.ExportLimit):
        ex.require_at_most(spark.range(11), 10)
    assert ex.require_at_most(spark.range(10), 10).count() == 10


def test_manifest_sees_every_change(spark):
    written, path = (scratch_path(spark, "export").replace("file:", "") for _ in range(2))
    ex.export_csv(cells(spark, ["a", "b"]).repartition(2), written, ["i", "v"])
    # A plain copy: the local file system keeps its own checksums beside written files.
    os.makedirs(path)
    for part in glob.glob(written + "/*.csv"):
        shutil.copy(part, path)
    manifest = spark.createDataFrame(ex.build_manifest(spark, path).collect())
    assert ex.verify_manifest(spark, path, manifest).count() == 0
    first, second = sorted(glob.glob(path + "/*.csv"))[:2]
    open(first, "a").write("more\n")
    data = open(second).read()
    open(second, "w").write(data[:-2] + "Z\n")
    open(path + "/new.csv", "w").write("x\n")
    problems = {x["name"]: x["problem"] for x in ex.verify_manifest(spark, path, manifest).collect()}
    assert sorted(problems.values()) == ["digest_mismatch", "size_mismatch", "unlisted"]


def test_digests_see_duplicates_and_nulls(spark):
    one = spark.createDataFrame([("a", None), ("b", "x")], "p string, q string")
    digest = lambda df: rc.frame_digest(df).first()["digest"]
    assert digest(one) == digest(one.orderBy(F.desc("p")))
    assert digest(one) != digest(one.unionByName(one.limit(1)))
    assert digest(one) != digest(one.fillna(""))
    assert digest(one) != digest(one.withColumnRenamed("q", "r"))


def test_row_rules_refuse_what_they_do_not_know(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    assert rw.apply_row_filters(df, [rw.IsNull("y")]).count() == 1
    for bad in (rw.Compare("x", "like", "a"), rw.Compare("x", "=", None), rw.AllOf((rw.IsNull("x"),)), "x > 1"):
        with pytest.raises(ValueError):
            rw.apply_row_filters(df, [bad])
    deep = rw.IsNull("y")
    for _ in range(18):
        deep = rw.AllOf((deep, rw.IsNull("x")))
    with pytest.raises(ValueError):
        rw.apply_row_filters(df, [deep])


def item(**kw):
    return {"type": "item", "filter_type": "logic", "field_id": 1, **kw}


def test_rule_trees_need_bound_variables(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "y string")
    tree = lambda **kw: {"logic": "and", "items": [item(**kw)]}
    rule = tree(term="in", value_type="variable", variable_id=9)
    assert rw.row_rule_filter(df, rule, {1: "y"}, {9: ["a", "b"]}).count() == 2
    assert rw.row_rule_filter(df, tree(term="eq", value_type="variable", variable_id=9), {1: "y"}, {9: ["b", "a"]}).first()["y"] == "b"
    for bad, variables in ((rule, {}), (tree(term="in", value="a"), {}), (tree(term="eq", value=""), {}), (tree(term="eq", value="a", field_id=2), {}), ({"logic": "xor", "items": [item(term="null")]}, {})):
        with pytest.raises(ValueError):
            rw.row_rule_filter(df, bad, {1: "y"}, variables)


def test_users_without_a_value_see_nothing(spark):
    rules = spark.createDataFrame([(1, 7, True), (2, 7, False)], "rule_id int, variable_id int, enabled boolean")
    targets = spark.createDataFrame([(1, "u1"), (1, "u2"), (2, "u3")], "rule_id int, user_id string")
    bindings = spark.createDataFrame([("u1", 7, "x"), ("u1", 7, "x"), ("u3", 7, "x")], "user_id string, variable_id int, value string")
    facts = spark.createDataFrame([("x", 1), ("y", 2)], "c string, n int")
    entitled = rw.entitlements(rules, targets, bindings)
    assert [tuple(x) for x in rw.secure_rows(facts, entitled, "c").select("user_id", "n").collect()] == [("u1", 1)]
    assert rw.visible_rows(facts, entitled, "c", "u2").count() == 0


def test_hidden_fields_are_unknown(spark):
    df = spark.createDataFrame([(1, "a")], "x int, secret string")
    view = governed(df, Access(columns=("x",)))
    register(spark, {"hidden_test": view})
    with pytest.raises(AnalysisException):
        spark.sql("SELECT secret FROM hidden_test")
    with pytest.raises(ValueError):
        assert_visible(view, ["secret"])
    assert view.columns == ["x"]


def test_governed_rows_are_a_subset(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 7)
    assert governed(df, Access(row_filters=(rw.Compare("g", "<", 3),))).exceptAll(df).count() == 0


def test_tenant_is_required(spark):
    with pytest.raises(ValueError):
        audit.for_tenant(spark.range(1), " ")


def test_unsafe_details(spark):
    values = ['{"a": {"db_password": 1}}', '[{"raw_values": []}]', '{"a": "password"}', '{"passwordless": 1}', '{"a": "x\\"password\\": 1"}', '{"pass\\u0077ord": 1}', "nope", '{"u": "MySQL://x"}', '{"TOKEN": 1}', "{}"]
    got = [x[0] for x in cells(spark, values).orderBy("i").select(audit.unsafe_details(F.col("v"))).collect()]
    assert got == [True, True, False, False, False, True, True, True, True, False]


def test_synthetic_history_counts(spark):
    made = audit.synthetic_audit(spark, 30, 10, dt.date(2024, 1, 30))
    counts = {x["decision"]: x["count"] for x in made.groupBy("decision").count().collect()}
    assert counts == {"allow": 180, "deny": 60, "warn": 36, "approve": 24}
    assert made.select(F.to_date("ts")).distinct().count() == 30


def test_quoted_names_and_longest_mentions(spark):
    questions = spark.createDataFrame([
        (1, 'total of order items and "orders"'), (2, "reorder or preorders"), (3, "orders_archive, orders"), (4, 'x "a ""b""" y'), (5, "[orders] `order`"), (6, "orders orders_archive2"),
    ], "question_id bigint, text string")
    names = spark.createDataFrame([("order",), ("orders",), ("order items",), ("orders_archive",), ('a "b"',)], "name string")
    got = sorted(map(tuple, r.find_mentions(questions, names).collect()))
    assert got == [(1, "order items"), (1, "orders"), (3, "orders"), (3, "orders_archive"), (4, 'a "b"'), (5, "order"), (5, "orders"), (6, "orders")]


def test_overlapping_places_of_a_name(spark):
    df = spark.createDataFrame([("a a a ab a", "a a")], "t string, n string")
    spans = df.select(r.name_spans(F.col("t"), F.col("n"), F.array().cast("array<struct<begin:int,end:int,name:string>>"))).first()[0]
    assert [(x["begin"], x["end"]) for x in spans] == [(1, 4), (3, 6)]


def test_hint_budget_skips_what_is_too_large(spark):
    df = spark.createDataFrame([([(1, 30), (2, 90), (3, 40), (4, 10)],)], "items array<struct<id:bigint,bytes:bigint>>")
    taken = df.select(r.take_within(F.col("items"), 8, 100)).first()[0]
    assert [x["id"] for x in taken] == [1, 3, 4]
    assert [x["id"] for x in df.select(r.take_within(F.col("items"), 1, 100)).first()[0]] == [1]


def test_forecast_needs_rising_labels_of_one_kind(spark):
    data = [("ok", str(2000 + i), 10.0 + 2 * i, i) for i in range(5)] + [("flat", "2020", 1.0, i) for i in range(4)] + [("short", "1", 1.0, 0)] + [("gap", x, float(y), i) for i, (x, y) in enumerate([("1", 1), ("2", 2), ("4", 4), ("8", 8)])]
    df = spark.createDataFrame(data, "g string, label string, v double, at int")
    got = {(x["g"], x["ahead"]): (x["label"], x["value"]) for x in s.forecast(df, ["g"], "label", "v", "at").collect()}
    assert got == {("ok", 1): ("2005", 20.0), ("ok", 2): ("2006", 22.0), ("ok", 3): ("2007", 24.0), ("gap", 1): ("10", 10.0), ("gap", 2): ("12", 12.0), ("gap", 3): ("14", 14.0)}


def test_forecast_prints_plain_digits_and_gives_up_whole_series(spark):
    data = [("frac", repr(12345678.5 + i), float(i), i) for i in range(3)] + [("huge", str(2000 + i), 4.9e14 * i, i) for i in range(3)]
    df = spark.createDataFrame(data, "g string, label string, v double, at int")
    got = {(x["g"], x["ahead"]): x["label"] for x in s.forecast(df, ["g"], "label", "v", "at").collect()}
    assert got == {("frac", 1): "12345681.5", ("frac", 2): "12345682.5", ("frac", 3): "12345683.5"}


def test_manifest_of_a_partitioned_folder(spark):
    path = scratch_path(spark, "partitioned").replace("file:", "")
    for part in ("a", "b"):
        os.makedirs(f"{path}/p={part}/_temporary")
        open(f"{path}/p={part}/part-0.csv", "w").write(part)
        open(f"{path}/p={part}/_temporary/x.csv", "w").write("x")
    manifest = spark.createDataFrame(ex.build_manifest(spark, path).collect())
    assert sorted(r["name"] for r in manifest.collect()) == ["p=a/part-0.csv", "p=b/part-0.csv"]
    assert ex.verify_manifest(spark, path, manifest).count() == 0
    assert ex.verify_manifest(spark, path, ex.build_manifest(spark, path, max_bytes=0)).count() == 0


def test_shared_folder_is_the_named_one(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
