"""Governed views: allowed columns, row filters, then masks, left to Catalyst as one plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from palisade.functions.masks import HashKey
from palisade.operators.redact import MaskRule, redact
from palisade.operators.rows import Predicate, apply_row_filters, predicate_column


@dataclass(frozen=True)
class Access:
    """What a principal may see of one table."""

    columns: Sequence[str] | None = None
    row_filters: Sequence[Predicate] = field(default_factory=tuple)
    masks: Sequence[MaskRule] = field(default_factory=tuple)


def governed(df: DataFrame, access: Access, key: HashKey | None = None) -> DataFrame:
    """Filters sit below the masks, so they see raw values and reach the scan."""
    visible = apply_row_filters(df, access.row_filters)
    if access.columns is not None:
        granted = {c.lower() for c in access.columns}
        visible = visible.select(*[c for c in df.columns if c.lower() in granted])
    return redact(visible, [m for m in access.masks if m.column in visible.columns], key)


def register(spark: SparkSession, views: dict[str, DataFrame]) -> None:
    """Register only governed views: a hidden field is then unknown to the analyzer."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)


def carry_filter(previous: Sequence[Predicate], df: DataFrame) -> DataFrame:
    """A follow-up question keeps the filters of the turn before."""
    return apply_row_filters(df, previous)


def assert_visible(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Fail as the analyzer would when a wanted field is not part of the governed view."""
    known = {c.lower() for c in df.columns}
    missing = [f for f in fields if f.lower() not in known]
    if missing:
        raise ValueError(f"fields are not visible: {missing}")
    return df.select(*fields)


__all__ = ["Access", "assert_visible", "carry_filter", "governed", "predicate_column", "register"]
