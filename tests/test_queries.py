"""Every registered query against its check SQL on the same tables, and what its plan must not hold."""

from __future__ import annotations

import re

import pytest

import oracle
from palisade.plans.catalog import CHECK_SQL, QUERIES


@pytest.fixture(scope="module")
def connection(sf_dir):
    return oracle.connect(sf_dir)


def test_every_query_has_check_sql():
    assert set(QUERIES) == set(CHECK_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, sf_dir, connection, name):
    df = QUERIES[name](spark, sf_dir)
    assert oracle.compare(df, connection, CHECK_SQL[name]) == []
    assert oracle.type_gaps(df, connection, CHECK_SQL[name]) == []
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan
    assert not re.search(r"Window \[[^\n]*\], \[\](,|\n)", plan), "window without a partition"
