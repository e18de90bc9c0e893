"""Ordered digests, manifests of large files, reports in one pass, sketches, tenant layout and versions of keyed tables."""

from __future__ import annotations

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from palisade.operators import audit
from palisade.operators import reconcile as rc
from palisade.operators import redact as r
from palisade.plans.mask_queries import CONTACT_RULES, KEY
from palisade.session import scratch_path
from palisade.sources import export as ex
from palisade.sources import tables as t
from palisade.sources import versions


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def digest(df, order=("at",), **options):
    return tuple(rc.ordered_digest(df, list(order), **options).first())


def test_ordered_digest_follows_the_row_order(spark):
    data = [(i, f"v{i % 7}") for i in range(500)]
    df = spark.createDataFrame(data, "at int, v string")
    base = digest(df, fan=8)
    assert base[0] == 500
    assert digest(df.repartition(7), fan=8) == base == digest(df.coalesce(1), fan=8)
    swapped = [(1 - i if i < 2 else i, v) for i, v in data]
    assert digest(spark.createDataFrame(swapped, "at int, v string"), fan=8) != base
    assert digest(df, [F.desc("at")], fan=8) != base
    assert digest(df.withColumnRenamed("v", "w"), fan=8) != base and digest(df, truncated=True, fan=8) != base
    # The order alone, without its column: equal rows may change places, different ones may not.
    values = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "v string, at int")
    moved = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "v string, at int")
    assert digest(values, fan=2) != digest(moved, fan=2)


def test_ordered_digest_is_a_tree_of_hashes(spark):
    from palisade.functions.hashing import row_digest

    df = spark.createDataFrame([(i,) for i in range(5)], "at int")
    level = [x.d for x in df.select("at", row_digest(["at"]).alias("d")).orderBy("at").collect()]
    while len(level) > 1:
        level = [hashlib.sha256("".join(level[i : i + 2]).encode()).hexdigest() for i in range(0, len(level), 2)]
    assert digest(df, fan=2) == (5, hashlib.sha256(f"at:5:{level[0]}".encode()).hexdigest())


def test_ordered_digest_of_few_and_equal_rows(spark):
    empty = spark.createDataFrame([], "at int")
    assert digest(empty)[0] == 0 and digest(empty) == digest(empty.repartition(3))
    same = spark.createDataFrame([(None,)] * 300 + [(1,)], "at int")
    assert digest(same, fan=4) == digest(same.repartition(5), fan=4)
    assert digest(same.limit(1))[0] == 1


def test_large_files_are_streamed(spark, tmp_path, monkeypatch):
    folder = tmp_path / "export"
    (folder / "a b").mkdir(parents=True)
    contents = {"small.csv": b"x", "a b/large #1.bin": os.urandom(3_000_000)}
    for name, data in contents.items():
        (folder / name).write_bytes(data)
    monkeypatch.setattr(ex, "BUFFER_BYTES", 4096)
    got = {x["name"]: (x["size"], x["sha256"]) for x in ex.build_manifest(spark, str(folder), max_bytes=100).collect()}
    assert got == {n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in contents.items()}
    whole = ex.build_manifest(spark, str(folder))
    assert rows(whole) == rows(ex.build_manifest(spark, str(folder), max_bytes=0))
    listed = spark.createDataFrame(whole.collect())
    assert ex.verify_manifest(spark, str(folder), listed, max_bytes=100).count() == 0
    with open(folder / "a b/large #1.bin", "r+b") as file:
        file.seek(2_000_000)
        file.write(b"\0" * 10)
    assert rows(ex.verify_manifest(spark, str(folder), listed, max_bytes=100)) == [("a b/large #1.bin", "digest_mismatch")]


def test_report_comes_with_the_one_scan(spark, sf_dir):
    frame, report = r.redact_observed(t.contact(spark, sf_dir), CONTACT_RULES, KEY)
    assert frame._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    path = scratch_path(spark, "observed")
    frame.write.parquet(path)
    assert rows(report()) == rows(r.redaction_report(t.contact(spark, sf_dir), CONTACT_RULES, KEY))
    assert rows(spark.read.parquet(path)) == rows(r.redact(t.contact(spark, sf_dir), CONTACT_RULES, KEY))


def test_sketches_of_days_combine(spark):
    hits = lambda ids: "[" + ",".join(f'{{"RuleID":"{i}","Decision":"deny"}}' for i in ids) + "]"
    data = [("t0" if n % 3 else None, f"2024-01-{1 + n % 7:02d} 10:00:00", hits([f"R{n % 5}", f"R{n % 11}"])) for n in range(400)]
    data += [("t0", "2024-01-01 10:00:00", "{broken"), ("t0", None, None)]
    log = spark.createDataFrame(data, "tenant_id string, ts string, rule_hits string").withColumn("ts", F.col("ts").cast("timestamp"))
    path = scratch_path(spark, "sketches")
    audit.rule_sketches(log).write.parquet(path)
    kept = spark.read.parquet(path)
    assert kept.count() == 14
    exploded = log.select("tenant_id", F.inline(F.from_json("rule_hits", "array<struct<RuleID:string,Decision:string>>"))).filter("RuleID IS NOT NULL")
    exact = audit.top_counts(exploded, "RuleID", 4, ["tenant_id"], "rule_id")
    assert rows(audit.top_of_sketches(kept, 4)) == rows(exact)
    # More rules than the sketch holds: the counts are off by no more than the stated share of all hits.
    many = spark.range(60_000).select(F.lit("t").alias("tenant_id"), F.lit("2024-01-01").cast("timestamp").alias("ts"),
        F.format_string('[{"RuleID":"%s","Decision":"deny"}]', F.when(F.col("id") % 10 < 3, "hot").otherwise(F.concat(F.lit("r"), (F.col("id") % 5000).cast("string")))).alias("rule_hits"))
    top = audit.top_of_sketches(audit.rule_sketches(many, capacity=64), 1, capacity=64).first()
    assert top.rule_id == "hot" and abs(top.n - 18_000) <= 3.5 / 64 * 60_000


def test_a_tenant_reads_its_own_files(spark, sf_dir):
    log, path = t.audit_log(spark, sf_dir), scratch_path(spark, "layout")
    versions.write_by_tenant(log, path, files=2)
    table = versions.read_by_tenant(spark, path, log)
    assert rows(table.drop("day").select(log.columns)) == rows(log)
    own = audit.for_tenant(table, "t0").filter("day >= DATE '2024-01-10'")
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tenant_id" in plan and "(tenant_id" in plan and "day" in plan.split("PartitionFilters")[1].split("]")[0]
    scanned = own._jdf.queryExecution().executedPlan()
    own.collect()
    opened = {f for f in os.popen(f"find {path} -name '*.parquet' -path '*tenant_id=t0*'").read().split()}
    metrics = scanned.toString()
    assert opened and "tenant_id=t1" not in metrics


def test_joins_prune_partitions_at_run_time(spark, sf_dir):
    log, path = t.audit_log(spark, sf_dir), scratch_path(spark, "layout-join")
    versions.write_by_tenant(log, path, files=2)
    table = versions.read_by_tenant(spark, path, log)
    tenants = spark.createDataFrame([("t1", "gold"), ("t0", "basic")], "tenant_id string, plan string").filter("plan = 'gold'")
    joined = table.join(F.broadcast(tenants), "tenant_id")
    assert joined.select("tenant_id").distinct().collect()[0][0] == "t1"
    stored = scratch_path(spark, "tenants")
    tenants.write.parquet(stored)
    plan = table.join(spark.read.parquet(stored).filter("plan = 'gold'"), "tenant_id")._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_versions_rewrite_only_what_changes(spark):
    schema = "k int, n string, fingerprint string"
    make = lambda data: spark.createDataFrame(data, schema)
    root, keys = scratch_path(spark, "versions"), ["k"]
    first = [(i, f"n{i}", f"f{i}") for i in range(100)]
    version, written = versions.merge_version(make(first), root, keys, "fingerprint", buckets=8)
    assert version == 1 and written == list(range(8))
    assert versions.merge_version(make(first), root, keys, "fingerprint", buckets=8) == (1, [])
    files = os.popen(f"find {root} -type f | wc -l").read()
    assert versions.merge_version(make(first[:50]), root, keys, "fingerprint", buckets=8) == (1, [])
    assert os.popen(f"find {root} -type f | wc -l").read() == files
    changed = [(3, "new", "g3"), (200, "added", "g200")]
    version, written = versions.merge_version(make(changed), root, keys, "fingerprint", removed=make([(5, "", "")]), buckets=8)
    assert version == 2 and 1 <= len(written) <= 3
    expected = sorted([x for x in first if x[0] not in (3, 5)] + changed)
    frame = make(first)
    assert rows(versions.read_version(spark, root, frame.schema)) == sorted(expected, key=repr)
    assert rows(versions.read_version(spark, root, frame.schema, 1)) == sorted(first, key=repr)


def test_a_failed_run_leaves_the_old_version(spark, monkeypatch):
    root = scratch_path(spark, "versions-failed")
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, fingerprint string")
    versions.merge_version(old, root, ["k"], "fingerprint", buckets=2)
    broken = spark.createDataFrame([(1, "c"), (7, "d")], "k int, fingerprint string").withColumn("fingerprint", F.when(F.col("k") == 7, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("fingerprint")))
    with pytest.raises(Exception, match="lost"):
        versions.merge_version(broken, root, ["k"], "fingerprint", buckets=2)
    assert versions.current_version(spark, root) == 1 and rows(versions.read_version(spark, root, old.schema)) == [(1, "a"), (2, "b")]


def test_an_empty_root_has_no_version(spark):
    schema = spark.createDataFrame([], "k int, fingerprint string").schema
    root = scratch_path(spark, "versions-none")
    assert versions.current_version(spark, root) == 0 and versions.read_version(spark, root, schema).count() == 0
    assert versions.merge_version(spark.createDataFrame([], schema), root, ["k"], "fingerprint") == (0, [])
