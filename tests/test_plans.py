"""The plans the queries must keep: pushed filters, pruned columns, early rank limits."""

from __future__ import annotations

import re

import pytest

from palisade.plans.catalog import QUERIES

def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("name", "wanted"), [
    ("row_filters", "c_acctbal,0.0"),
    ("governed_view", "c_nationkey,15"),
    ("bounded_read", "s_nationkey,3"),
    ("carry_filter", "o_custkey,100"),
])
def test_filters_reach_the_scan(spark, sf_dir, name, wanted):
    pushed = re.findall(r"PushedFilters: \[(.*?)\]", plan(QUERIES[name](spark, sf_dir)))
    assert any(wanted in p for p in pushed)


def test_only_needed_columns_are_read(spark, sf_dir):
    text = plan(QUERIES["hide_columns"](spark, sf_dir))
    assert "o_totalprice" not in text.split("ReadSchema")[1]
    text = plan(QUERIES["audit_status"](spark, sf_dir))
    read = text.split("ReadSchema")[1]
    assert "value" not in read and "user_id" not in read


@pytest.mark.parametrize("name", ["risk_top", "agent_ranking", "recent_history"])
def test_ranks_are_limited_before_the_shuffle(spark, sf_dir, name):
    assert "WindowGroupLimit" in plan(QUERIES[name](spark, sf_dir))


def test_wide_tables_are_profiled_in_parts(spark):
    from pyspark.sql import functions as F

    from palisade.sources.ingest import infer_types

    wide = spark.range(3).select(*[F.col("id").cast("string").alias(f"c{i}") for i in range(230)])
    kinds = infer_types(wide)
    assert plan(kinds).count("Scan") + plan(kinds).count("Range") >= 3
    assert {r["type"] for r in kinds.collect()} == {"int"} and kinds.count() == 230


def test_no_query_forces_a_broadcast(spark, sf_dir):
    """With both thresholds off nothing is sent to all tasks: no join needs it."""
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        for name in ("in_subquery", "exists_subquery", "secure_rows", "key_access", "authorize_uses", "risk_hits"):
            plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastExchange" not in plan and "NestedLoop" not in plan, name
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
