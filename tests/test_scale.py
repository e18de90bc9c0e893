"""Split and blocked forms give the same answer as the plain ones, also on skewed keys."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from palisade.functions import folds
from palisade.functions.contains import contains_pairs
from palisade.functions.segments import previous, row_numbers, running, time_slice
from palisade.operators import chain as c
from palisade.operators import risk as rk
from palisade.operators import vectors as v
from palisade.plans.integrity_queries import CONFIG, HMAC_CONFIG
from palisade.sources import tables as t
from palisade.streaming import ordered as o


@pytest.fixture(scope="module")
def skewed(spark, sf_dir):
    """The log with a third of all rows under one key."""
    log = t.audit_log(spark, sf_dir).drop("k")
    return log.withColumn("chain_id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("agent_id"))).withColumn(
        "tenant_id", F.when(F.col("id") % 3 == 0, "t0").otherwise(F.col("tenant_id"))
    ).cache()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_split_windows_equal_plain_windows(skewed):
    keys, order = ["chain_id"], ["ts", "id"]
    plain = Window.partitionBy(*keys).orderBy(*order)
    cut = time_slice("ts", "day")
    a = row_numbers(skewed, keys, order, cut, "n").select("id", "n")
    assert rows(a) == rows(skewed.select("id", F.row_number().over(plain).cast("bigint").alias("n")))
    a = running(skewed, keys, order, cut, F.col("est_rows"), "s").select("id", "s")
    assert rows(a) == rows(skewed.select("id", F.sum("est_rows").over(plain.rowsBetween(Window.unboundedPreceding, 0)).alias("s")))
    a = previous(skewed, keys, order, cut, ["decision", "error_code"]).select("id", "prev_decision", "prev_error_code")
    assert rows(a) == rows(skewed.select("id", F.lag("decision").over(plain), F.lag("error_code").over(plain)))


def test_blocked_folds_equal_one_pass(skewed):
    whole, blocks = c.build_chain(skewed, CONFIG), c.build_chain(skewed, CONFIG, max_block_rows=90)
    assert rows(whole) == rows(blocks)
    assert rows(rk.rate_limits(skewed, 0.0005, 2)) == rows(rk.rate_limits(skewed, 0.0005, 2, max_block_rows=11))
    tries = skewed.withColumn("user_name", F.col("agent_id"))
    assert rows(o.attempt_limits(tries, "user_name", 2, 86400.0)) == rows(o.attempt_limits(tries, "user_name", 2, 86400.0, max_block_rows=5))


def test_a_long_key_gets_larger_blocks_not_more(skewed, monkeypatch):
    taken = []
    inner = folds._in_blocks
    monkeypatch.setattr(folds, "_in_blocks", lambda *a: taken.append(inner(*a)) or taken[-1])
    assert rows(c.build_chain(skewed, CONFIG, max_block_rows=3)) == rows(c.build_chain(skewed, CONFIG))
    assert [len(paths) for paths, _ in taken] == [folds.MAX_BLOCKS]
    assert folds.block_rows(100, 20) == 20 and folds.block_rows(10**12, 20) == folds.MAX_BLOCK_ROWS


def test_contains_agrees_with_brute_force(spark):
    rng = random.Random(3)
    words = ["ab", "a", "中文", "the cat", "cat", "atc", "xyz", "ca", "tt"]
    texts = ["".join(rng.choice(["a", "b", "c", "t", " ", "中", "文", "the cat"]) for _ in range(rng.randint(0, 12))) for _ in range(120)] + ["", None]
    hay = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    phrases = spark.createDataFrame([(w,) for w in words] + [("",)], "w string")
    expected = sorted((i, w) for i, text in enumerate(texts) if text for w in words if w in text)
    got = contains_pairs(hay, "id", "text", phrases, "w")
    assert sorted(map(tuple, got.collect())) == expected


def test_top_k_scans_agree_with_numpy(spark):
    rng = np.random.default_rng(5)
    matrix = rng.normal(size=(300, 8))
    matrix[10] = matrix[20]  # a tie
    matrix[30] = 0.0
    frame = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(matrix)], "id bigint, vector array<double>").repartition(5)
    queries = frame.filter("id % 37 = 10")
    unit = matrix / np.where(np.linalg.norm(matrix, axis=1) > 0, np.linalg.norm(matrix, axis=1), 1)[:, None]
    expected = []
    for q in range(10, 300, 37):
        s = np.round(unit[q] @ unit.T, 12)
        order = [i for i in np.lexsort((np.arange(300), -s)) if i != 30][:4]
        expected += [(q, int(i), rank) for rank, i in enumerate(order, start=1)]
    for scans in (v.QUERIES_PER_SCAN, 2):
        got = v.top_k(frame, queries, 4, queries_per_scan=scans).select("query_id", "candidate_id", "rank")
        assert rows(got) == sorted(expected, key=repr)


def chained(df, config):
    return df.join(c.build_chain(df, config).drop("tenant_id", "chain_id"), "id")


@pytest.mark.parametrize("config", [CONFIG, HMAC_CONFIG])
def test_intact_chains_verify(skewed, config):
    built = chained(skewed, config)
    outcomes = c.verify_chain(built, c.chain_state(built, config), config, seq_block=17).select("outcome", "code").distinct()
    assert rows(outcomes) == [(c.VALID, 0)]


def test_each_damage_is_named(spark, skewed):
    hot = skewed.filter("chain_id = 'hot'")
    built = chained(hot, CONFIG).cache()
    state = c.chain_state(built, CONFIG)
    at = F.col("chain_seq") == 40
    changes = {
        c.GAP: built.filter(~at),
        c.DUPLICATE: built.withColumn("chain_seq", F.when(at, 39).otherwise(F.col("chain_seq"))),
        c.SELF_MISMATCH: built.withColumn("decision", F.when(at, "x").otherwise(F.col("decision"))),
        c.PREV_MISMATCH: built.withColumn("prev_hash", F.when(at, F.sha2(F.lit("x"), 256)).otherwise(F.col("prev_hash"))),
        c.BAD_FORMAT: built.withColumn("chain_format_version", F.when(at, 2).otherwise(F.col("chain_format_version"))),
        c.MODE_DOWNGRADE: built.withColumn("chain_key_version", F.when(at, 1).otherwise(F.col("chain_key_version"))),
        c.HALF_CHAINED: built.withColumn("self_hash", F.when(~at, F.col("self_hash"))),
        c.HEAD_MISMATCH: built.filter(F.col("chain_seq") < F.lit(40)),
    }
    for reason, damaged in changes.items():
        outcome = c.verify_chain(damaged, state, CONFIG, seq_block=10).first()
        assert outcome["outcome"] == reason, reason
        assert outcome["code"] == 2 == c.exit_class(reason)
        if reason in (c.GAP, c.SELF_MISMATCH, c.PREV_MISMATCH, c.BAD_FORMAT, c.MODE_DOWNGRADE):
            assert outcome["break_seq"] == 40
    for status, result in (("DISABLED", c.DISABLED), ("FAILED", c.FAILED), ("BUILDING", c.INCOMPLETE)):
        outcome = c.verify_chain(built, state.withColumn("status", F.lit(status)), CONFIG).first()
        assert (outcome["outcome"], outcome["code"]) == (result, 4)
    wrong = c.verify_chain(built, state.withColumn("mode", F.lit("hmac")), CONFIG).first()
    assert (wrong["outcome"], wrong["break_seq"]) == (c.MODE_DOWNGRADE, 0)
    assert c.exit_class(c.VALID) == 0 and c.exit_class("x", key_available=False) == 3 and c.exit_class("x", runtime_error=True) == 5


def test_checkpoint_links(spark):
    from palisade.operators.chain import checkpoint_digest

    base = dt.datetime(2024, 1, 1)
    link, data = None, []
    for i in range(1, 8):
        row = ("t0", "c", i, f"{i:064x}", base + dt.timedelta(hours=i), base + dt.timedelta(hours=i), i * 10, f"{i:064x}", link)
        columns = "tenant_id string, chain_id string, ordinal bigint, archive_sha256 string, created_at timestamp_ntz, signed_at timestamp_ntz, head_seq bigint, head_hash string, previous_sha256 string"
        link = spark.createDataFrame([row], columns).select(checkpoint_digest()).first()[0]
        data.append(row)
    frame = spark.createDataFrame(data, columns)
    assert rows(c.verify_checkpoints(frame, block=3)) == []
    broken = frame.withColumn("head_hash", F.when(F.col("ordinal") == 4, "0" * 64).otherwise(F.col("head_hash")))
    assert [(r["ordinal"], r["problem"]) for r in c.verify_checkpoints(broken, block=3).collect()] == [(5, "link_broken")]
    same_head = frame.withColumn("head_seq", F.when(F.col("ordinal") == 3, 20).otherwise(F.col("head_seq")))
    assert ("t0", "c", 3, "head_hash_changed") in rows(c.verify_checkpoints(same_head))
