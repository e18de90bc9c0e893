"""Rows with null keys and null times: none is lost, whatever the slices and blocks."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from palisade.functions.segments import join_same, previous, row_numbers, running, time_slice
from palisade.operators import audit
from palisade.operators import chain as c
from palisade.operators import risk as rk
from palisade.plans.integrity_queries import CONFIG
from palisade.plans.sparse_queries import sparse
from palisade.streaming import ordered as o

START = dt.datetime(2024, 1, 1)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def log(spark, sf_dir):
    return sparse(spark, sf_dir).cache()


def test_split_windows_keep_null_keys_and_times(log):
    keys, order, cut = ["tenant_id", "session_id"], ["ts", "id"], time_slice("ts", "day")
    plain = Window.partitionBy(*keys).orderBy(*order)
    assert rows(row_numbers(log, keys, order, cut, "n").select("id", "n")) == rows(log.select("id", F.row_number().over(plain).cast("bigint")))
    upto = plain.rowsBetween(Window.unboundedPreceding, 0)
    assert rows(running(log, keys, order, cut, F.col("est_rows"), "s").select("id", "s")) == rows(log.select("id", F.sum("est_rows").over(upto)))
    got = previous(log, keys, order, cut, ["decision", "ts"]).select("id", "prev_decision", "prev_ts")
    assert rows(got) == rows(log.select("id", F.lag("decision").over(plain), F.lag("ts").over(plain)))


def test_join_same_matches_null_with_null(spark):
    a = spark.createDataFrame([(None, 1, "x"), ("k", None, "y"), (None, None, "z")], "k string, n int, v string")
    b = spark.createDataFrame([(None, 1, 10), ("k", None, 20)], "k string, n int, w int")
    assert rows(join_same(a, b, ["k", "n"], "left")) == sorted([(None, 1, "x", 10), ("k", None, "y", 20), (None, None, "z", None)], key=repr)


@pytest.mark.parametrize("size", [1, 2, 50])
def test_blocks_agree_on_null_keys_and_times(log, size):
    part = log.filter("id < 300")
    for fold in (
        lambda n: rk.rate_limits(part, 0.0005, 2, **n),
        lambda n: o.attempt_limits(part.withColumn("user_name", F.coalesce("agent_id", F.lit("u"))), "user_name", 2, 86400.0, **n),
        lambda n: c.build_chain(part.withColumn("chain_id", F.col("agent_id")), CONFIG, **n),
    ):
        whole = rows(fold({}))
        assert rows(fold({"max_block_rows": size if size > 1 else 7})) == whole
    assert len(rows(rk.rate_limits(part, 0.0005, 2, max_block_rows=size + 1))) == part.count()


def test_requests_without_a_time_leave_the_bucket_alone(spark):
    data = [("t", "a", 1, None, 0), ("t", "a", 2, START, 0), ("t", "a", 3, START, 0), (None, None, 4, None, 0), (None, None, 5, START, 0)]
    df = spark.createDataFrame(data, "tenant_id string, agent_id string, id bigint, ts timestamp, latency_ms bigint")
    assert {(r.id, r.limit_reason) for r in rk.rate_limits(df, 1, 5).collect()} == {(1, "no_time"), (2, ""), (3, "qps"), (4, "no_time"), (5, "")}


def test_kpi_of_a_null_tenant_is_one_row(spark):
    moment = dt.datetime(2024, 1, 30)
    log = spark.createDataFrame([(None, moment, "deny")], "tenant_id string, ts timestamp, decision string")
    other = spark.createDataFrame([(None, "pending")], "tenant_id string, status string")
    active = spark.createDataFrame([(None, "active")], "tenant_id string, status string")
    got = audit.kpi(log, other, active, other, audit.DayWindow(14, moment + dt.timedelta(hours=1))).collect()
    assert [(r.tenant_id, r.total_requests, r.blocked, r.pending_approvals, r.active_agents, r.datasources_total) for r in got] == [(None, 1, 1, 1, 1, 1)]


def test_a_chain_with_a_null_key_is_checked(spark, log):
    own = log.filter("id < 200").withColumns({"chain_id": F.col("agent_id"), "ts": F.coalesce("ts", F.lit(START).cast("timestamp_ntz"))})
    chained = own.join(c.build_chain(own, CONFIG).drop("tenant_id", "chain_id"), "id")
    state = c.chain_state(chained, CONFIG)
    assert {r.outcome for r in c.verify_chain(chained, state, CONFIG).collect()} == {c.VALID}
    broken = chained.withColumn("sql_raw", F.when(F.col("chain_id").isNull() & (F.col("chain_seq") == 2), "changed"))
    found = {(r.chain_id, r.outcome) for r in c.verify_chain(broken, state, CONFIG).collect() if r.outcome != c.VALID}
    assert found == {(None, c.SELF_MISMATCH)}
