"""Side-by-side run of a registered query and its check SQL on the same Parquet tables."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

from palisade.sources.tables import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, (int, float, decimal.Decimal)):
        return ("n", round(float(value), 9) if not isinstance(value, int) else value)
    if isinstance(value, dt.datetime):
        return ("t", value.replace(tzinfo=None).isoformat())
    if isinstance(value, dt.date):
        return ("d", value.isoformat())
    if isinstance(value, (bytes, bytearray)):
        return ("x", bytes(value).hex())
    if isinstance(value, (list, tuple)):
        return ("l", tuple(cell(v) for v in value))
    return ("s", str(value))


def _rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in records), key=repr)


def compare(spark_df, connection, sql: str) -> list[str]:
    """Differences in columns, row count and values; empty when both sides agree."""
    relation = connection.execute(sql)
    sql_names = [c[0] for c in relation.description]
    sql_records = relation.fetchall()
    records = spark_df.collect()
    if sorted(sql_names) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} against {sorted(sql_names)}"]
    left, right = _rows(spark_df.columns, records), _rows(sql_names, sql_records)
    problems = []
    if len(left) != len(right):
        problems.append(f"rows {len(left)} against {len(right)}")
    different = [(a, b) for a, b in zip(left, right) if a != b]
    if left != right:
        problems.extend(f"{a} against {b}" for a, b in different[:3])
    return problems


def type_gaps(spark_df, connection, sql: str) -> list[str]:
    """Columns whose type family differs; wide integers and decimals count as a gap."""
    family = {
        "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean",
        "TIMESTAMP": "timestamp_ntz", "DATE": "date", "FLOAT": "float",
    }
    kinds = {n: str(k) for n, k in zip(connection.sql(sql).columns, connection.sql(sql).types)}
    return [
        f"{f.name}: {f.dataType.simpleString()} against {kinds.get(f.name)}"
        for f in spark_df.schema.fields
        if family.get(kinds.get(f.name, ""), kinds.get(f.name, "")).lower() != f.dataType.simpleString()
    ]
