"""Registry of named queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from palisade.session import configure
from palisade.sources.tables import AUDIT_LOG_SQL, CONTACT_SQL, SIGNALS_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECK_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without `sql` only its rows can be checked from outside."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            CHECK_SQL[name] = sql.strip()
        return fn

    return add


def over_audit(body: str, *ctes: str) -> str:
    return _with([f"audit_log AS ({AUDIT_LOG_SQL})", *ctes], body)


def over_contact(body: str, *ctes: str) -> str:
    return _with([f"contact AS ({CONTACT_SQL})", *ctes], body)


def over_signals(body: str, *ctes: str) -> str:
    return _with([f"audit_log AS ({AUDIT_LOG_SQL})", f"signals AS ({SIGNALS_SQL})", *ctes], body)


def _with(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def with_ctes(body: str, *ctes: str) -> str:
    return _with(list(ctes), body)
