"""Reading text files as typed tables, and small controlled reads of any table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.functions.numbers import half_away_of
from palisade.functions.profile import per_column
from palisade.functions.text import utrim

CORRUPT = "_corrupt_record"
MAX_HEADER_BYTES, MAX_CELL_BYTES = 63, 65_536
_CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"


def read_text_table(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """A CSV folder or file as all-text columns, byte order mark removed.

    Rows whose width differs from the header keep their raw text in `_corrupt_record`. `multiline`
    allows line breaks inside quotes, at the price of one task per file.
    """
    reader = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", multiline).option("escape", '"')
    names = reader.csv(path).columns  # only the header is read
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])
    df = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("enforceSchema", True).schema(schema).csv(path)
    return df.withColumnRenamed(names[0], names[0].lstrip("﻿"))


def encoding_report(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the raw files that are not UTF-8 or hold a NUL, counted."""
    lines = spark.read.text(path)
    return lines.agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(~F.is_valid_utf8("value")).alias("invalid_utf8"),
        F.count_if(F.col("value").contains("\0")).alias("with_nul"),
    )


def _cells(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != CORRUPT]


_INTEGER = r"^[+-]?[0-9]+$"
_FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _finite(c: Column) -> Column:
    number = F.when(c.rlike(_FLOAT), c.try_cast("double"))
    return F.when(F.abs(number) < float("inf"), number)


def infer_types(df: DataFrame) -> DataFrame:
    """Type per column from all rows in one aggregate: int, else float, else string; blanks are ignored."""
    def aggregates(i: int, name: str) -> list[Column]:
        cell = utrim(F.col(f"`{name}`"))
        blank = F.coalesce(cell == "", F.lit(True))
        is_int = cell.rlike(_INTEGER) & cell.try_cast("bigint").isNotNull()
        return [
            F.bool_and(blank | F.coalesce(is_int, F.lit(False))).alias(f"__i{i}"),
            F.bool_and(blank | _finite(cell).isNotNull()).alias(f"__f{i}"),
            F.count_if(~blank).alias(f"__n{i}"),
        ]

    def row(i: int, name: str) -> Column:
        kind = F.when(F.col(f"__n{i}") == 0, "string").when(F.col(f"__i{i}"), "int").when(F.col(f"__f{i}"), "float").otherwise("string")
        return F.struct(F.lit(name).alias("field"), F.lit(i).alias("position"), kind.alias("type"))

    return per_column(df, _cells(df), aggregates, row)


_IMPORT_NUMBER = r"^[+-]?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]{1,3})?$"
_CLOCK = r"([01]?[0-9]|2[0-3]):[0-5][0-9]"
_SECONDS = r":[0-5][0-9]([.,][0-9]+)?"
_DAY = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
_ZONED = rf"^{_DAY}T{_CLOCK}{_SECONDS}(Z|[+-][0-9]{{2}}:[0-9]{{2}})$"
_UNZONED = rf"^{_DAY}( {_CLOCK}({_SECONDS})?)?$"


def typed_cell(c: Column, kind: str) -> Column:
    """The cell as int (halves away from zero), float, datetime or string; blank is NULL, misfits are NULL."""
    cell = utrim(c)
    if kind == "string":
        return F.when(cell != "", c)
    if kind == "int":
        accepted = cell.rlike(_IMPORT_NUMBER) & (F.octet_length(cell) <= 128)
        return half_away_of(cell, accepted).try_cast("bigint")
    if kind == "float":
        return _finite(cell)
    if kind == "datetime":
        text = F.replace(cell, F.lit(","), F.lit("."))
        zoned = F.when(cell.rlike(_ZONED), text.try_cast("timestamp")).cast("timestamp_ntz")
        plain = F.when(cell.rlike(_UNZONED), text.try_cast("timestamp_ntz"))
        moment = F.coalesce(zoned, plain)
        return F.when(F.year(moment).between(1, 9999), moment)
    raise ValueError(f"unknown field type {kind!r}")


def _misfits(df: DataFrame, spec: Mapping[str, str]) -> Column:
    """Names of the columns whose non-blank cell does not fit its type."""
    found = [
        F.when(F.coalesce(utrim(F.col(f"`{n}`")) != "", F.lit(False)) & typed_cell(F.col(f"`{n}`"), k).isNull(), F.lit(n))
        for n, k in spec.items()
    ]
    if CORRUPT in df.columns:
        found.append(F.when(F.col(CORRUPT).isNotNull(), F.lit(CORRUPT)))
    return F.array_compact(F.array(*found))


def convert_types(df: DataFrame, spec: Mapping[str, str], on_error: str = "fail") -> DataFrame | tuple[DataFrame, DataFrame]:
    """Typed columns after `spec`. A misfit fails the job, or with "quarantine" its row is set aside."""
    keep = [c for c in _cells(df) if c not in spec]
    typed = [typed_cell(F.col(f"`{n}`"), k).alias(n) for n, k in spec.items()]
    flagged = df.withColumn("__bad", _misfits(df, spec))
    if on_error == "quarantine":
        good = flagged.filter(F.size("__bad") == 0).select(*keep, *typed)
        bad = flagged.filter(F.size("__bad") > 0).withColumnRenamed("__bad", "bad_fields")
        return good, bad
    if on_error != "fail":
        raise ValueError("on_error must be fail or quarantine")
    stop = F.raise_error(F.concat(F.lit("cells do not fit their type: "), F.array_join("__bad", ", ")))
    return flagged.filter(F.when(F.size("__bad") == 0, True).otherwise(stop.cast("boolean"))).select(*keep, *typed)


def header_problems(names: Sequence[str]) -> list[tuple[str, str]]:
    """Header rules: not empty, trimmed, at most 63 bytes, printable, unique without case."""
    problems, seen = [], set()
    for name in names:
        if not name or name != name.strip():
            problems.append(("header_blank_or_untrimmed", name))
        if len(name.encode()) > MAX_HEADER_BYTES:
            problems.append(("header_too_long", name))
        if any(ord(ch) < 32 or 127 <= ord(ch) < 160 for ch in name):
            problems.append(("header_control_character", name))
        if name.lower() in seen:
            problems.append(("header_repeated", name))
        seen.add(name.lower())
    return problems


def ingest_quality(df: DataFrame) -> DataFrame:
    """One row per violation class with its count; the cells are checked in a single aggregate."""
    # Headers may repeat, so the cells are addressed by position.
    numbered = df.toDF(*[c if c == CORRUPT else f"__c{i}" for i, c in enumerate(df.columns)])
    cells = [F.col(c) for c in numbered.columns if c != CORRUPT]
    any_cell = lambda check: reduce(lambda a, b: a | b, [F.coalesce(check(c), F.lit(False)) for c in cells])
    problems = header_problems(_cells(df))
    counts = {
        "row_width": F.count_if(F.col(CORRUPT).isNotNull()) if CORRUPT in df.columns else F.lit(0).cast("bigint"),
        "control_character": F.count_if(any_cell(lambda c: c.rlike(_CONTROL))),
        "cell_too_long": F.count_if(any_cell(lambda c: F.octet_length(c) > MAX_CELL_BYTES)),
        "invalid_utf8": F.count_if(any_cell(lambda c: ~F.is_valid_utf8(c))),
    }
    headers = {"header_blank_or_untrimmed", "header_too_long", "header_control_character", "header_repeated"}
    fixed = {name: sum(1 for p, _ in problems if p == name) for name in sorted(headers)}
    wide = numbered.agg(*[expression.alias(name) for name, expression in counts.items()])
    rows = [F.struct(F.lit(n).alias("violation"), F.col(n).alias("n")) for n in counts]
    rows += [F.struct(F.lit(n).alias("violation"), F.lit(v).cast("bigint").alias("n")) for n, v in fixed.items()]
    return wide.select(F.inline(F.array(*rows)))


def preview(df: DataFrame, spec: Mapping[str, str], n: int = 10) -> DataFrame:
    """The first rows, typed, blanks as NULL."""
    return df.limit(n).select(*[typed_cell(F.col(f"`{c}`"), spec.get(c, "string")).alias(c) for c in _cells(df)])


def sample_columns(df: DataFrame, columns: Sequence[str], n: int, order: Sequence[str] = ()) -> DataFrame:
    """A bounded sample of some columns: a sampling feature, not a way to profile a table."""
    return (df.orderBy(*order) if order else df).select(*columns).limit(n)


def bounded_read(df: DataFrame, fields: Sequence[str], equals: Mapping[str, object], limit: int) -> DataFrame:
    """Rows where all given fields equal their value, a few fields only, at most 100 rows."""
    if not fields or not equals or not 1 <= limit <= 100:
        raise ValueError("name at least one field and one filter, and a limit from 1 to 100")
    for name in sorted(equals):
        df = df.filter(F.col(name) == F.lit(equals[name]))
    return df.select(*fields).limit(limit)


def capped(df: DataFrame, n: int) -> tuple[DataFrame, bool]:
    """At most n rows, and whether another one existed."""
    return df.limit(n), df.limit(n + 1).count() > n


def field_values(df: DataFrame, column: str, n: int = 100) -> DataFrame:
    """Smallest n distinct values of a field; the distinct runs map-side first."""
    return df.select(column).distinct().orderBy(column).limit(n)
