"""Recursion by rounds, cycles, and permissions through inherited roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.operators.policy import effective_permissions
from palisade.operators.recursion import leading_into_cycles, recurse


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_rounds_go_on_until_one_is_empty(spark):
    seed = spark.createDataFrame([(3,), (1,), (1,)], "n int")
    down = lambda r: r.filter("n > 0").select((F.col("n") - 1).alias("n"))
    got = rows(recurse(seed, down, round_column="k"))
    assert got == sorted([(3, 0), (2, 1), (1, 2), (0, 3), (1, 0), (1, 0), (0, 1), (0, 1)], key=repr)
    assert rows(recurse(seed, down, distinct=True)) == [(0,), (1,), (2,), (3,)]
    assert recurse(seed.limit(0), down).count() == 0


def test_distinct_rows_end_in_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), (None, "x"), ("d", None)], "s string, e string")
    onward = lambda r: r.join(edges, "s").select(F.col("e").alias("s"))
    assert rows(recurse(spark.createDataFrame([("x",), (None,)], "s string"), onward, distinct=True)) == [("a",), ("b",), ("c",), ("x",), (None,)]
    assert rows(leading_into_cycles(edges, "s", "e")) == [("a",), ("b",), ("c",), ("x",)]
    assert rows(leading_into_cycles(edges.filter("s <> 'c'"), "s", "e")) == []


def test_permissions_of_a_long_chain_a_cycle_and_an_unknown_role(spark):
    chain = [(f"r{i}", f"r{i + 1}") for i in range(12)]
    roles = spark.createDataFrame([(f"r{i}",) for i in range(13)] + [("a",), ("b",), ("self",)], "role_id string")
    parents = spark.createDataFrame(chain + [("a", "b"), ("b", "a"), ("self", "self")], "role_id string, parent_id string")
    permissions = spark.createDataFrame([("r0", "p0"), ("r12", "p12"), ("a", "pa"), ("r5", "p5")], "role_id string, permission string")
    users = spark.createDataFrame([("u", "r0"), ("u", "r0"), ("v", "r6"), ("w", "a"), ("s", "self"), ("g", "ghost"), ("g", "r0")], "user_id string, role_id string")
    got = rows(effective_permissions(roles, parents, permissions, users))
    assert got == sorted([("u", "p0", False), ("u", "p12", False), ("u", "p5", False), ("v", "p12", False), ("w", None, True), ("s", None, True), ("g", None, True)], key=repr)
