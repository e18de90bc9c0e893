"""Row-level rules: whitelisted predicates, and/or rule trees, and per-user entitlements."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DEPTH = 16
MAX_PARTS = 100
MAX_FILTERS = 16

_COMPARE: dict[str, Callable[[Column, Any], Column]] = {
    "=": lambda c, v: c == v,
    "<>": lambda c, v: c != v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
}


@dataclass(frozen=True)
class Compare:
    """One column against one literal."""

    column: str
    op: str
    value: str | int | float | bool


@dataclass(frozen=True)
class IsNull:
    column: str
    negated: bool = False


@dataclass(frozen=True)
class AllOf:
    parts: tuple


@dataclass(frozen=True)
class AnyOf:
    parts: tuple


Predicate = Compare | IsNull | AllOf | AnyOf


def predicate_column(p: Predicate, depth: int = 0) -> Column:
    """A whitelisted predicate as a column; anything else is refused."""
    if depth > MAX_DEPTH:
        raise ValueError("row filter is nested too deeply")
    match p:
        case Compare(column, op, value) if op in _COMPARE and value is not None:
            return _COMPARE[op](F.col(f"`{column}`"), F.lit(value))
        case IsNull(column, negated):
            return F.col(f"`{column}`").isNotNull() if negated else F.col(f"`{column}`").isNull()
        case AllOf(parts) | AnyOf(parts) if 2 <= len(parts) <= MAX_PARTS:
            columns = [predicate_column(part, depth + 1) for part in parts]
            combine = (lambda a, b: a & b) if isinstance(p, AllOf) else (lambda a, b: a | b)
            return reduce(combine, columns)
    raise ValueError(f"unsupported row filter {p!r}")


def apply_row_filters(df: DataFrame, filters: Sequence[Predicate]) -> DataFrame:
    """All filters AND-ed onto the frame, below any mask, so they reach the scan."""
    if len(filters) > MAX_FILTERS:
        raise ValueError("too many row filters")
    for p in filters:
        df = df.filter(predicate_column(p))
    return df


# Comparison names of a rule tree.
TREE_TERMS = {"eq": "=", "not_eq": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}
TREE_DEPTH, TREE_ITEMS, VARIABLE_VALUES, VALUE_CHARS = 8, 16, 100, 256


def row_rule_column(
    tree: Mapping[str, Any], fields: Mapping[int, str], variables: Mapping[int, Sequence[str]] | None = None, depth: int = 0
) -> Column:
    """An and/or rule tree as a column. `variables` are the user's bound values by id.

    Scalar terms on a variable use its first value; `in` and `not in` take variables only. An
    unknown field, an unbound variable or an empty value refuses the whole rule.
    """
    logic = str(tree.get("logic", "")).lower()
    items = tree.get("items") or []
    if depth > TREE_DEPTH or not 1 <= len(items) <= TREE_ITEMS or logic not in ("and", "or"):
        raise ValueError("invalid rule tree")
    parts = []
    for item in items:
        if item.get("type") == "tree" and item.get("sub_tree"):
            parts.append(row_rule_column(item["sub_tree"], fields, variables, depth + 1))
        elif item.get("type") == "item" and not item.get("sub_tree"):
            parts.append(_tree_item(item, fields, variables or {}))
        else:
            raise ValueError("invalid rule tree item")
    combine = (lambda a, b: a & b) if logic == "and" else (lambda a, b: a | b)
    return reduce(combine, parts)


def _tree_item(item: Mapping[str, Any], fields: Mapping[int, str], variables: Mapping[int, Sequence[str]]) -> Column:
    name = fields.get(item.get("field_id"))
    if name is None or item.get("filter_type") != "logic":
        raise ValueError("rule names no known field")
    column, term = F.col(f"`{name}`"), item.get("term")
    bound = item.get("value_type") == "variable"
    if bound:
        values = list(variables.get(item.get("variable_id"), ()))
        if not 1 <= len(values) <= VARIABLE_VALUES:
            raise ValueError("rule variable is not bound")
    elif item.get("value_type") in (None, "", "normal"):
        values = [item.get("value", "")]
    else:
        raise ValueError("unknown value type")
    if term in ("null", "not_null"):
        return column.isNull() if term == "null" else column.isNotNull()
    if any(not v or len(v) > VALUE_CHARS or "\\" in v or "\0" in v for v in values):
        raise ValueError("rule value is not allowed")
    if term in ("in", "not in"):
        if not bound:
            raise ValueError("in needs a user variable")
        return column.isin(*values) if term == "in" else ~column.isin(*values)
    if term not in TREE_TERMS:
        raise ValueError(f"unknown term {term!r}")
    return _COMPARE[TREE_TERMS[term]](column, F.lit(values[0]))


def row_rule_filter(
    df: DataFrame, tree: Mapping[str, Any], fields: Mapping[int, str], variables: Mapping[int, Sequence[str]] | None = None
) -> DataFrame:
    return df.filter(row_rule_column(tree, fields, variables))


def entitlements(rules: DataFrame, targets: DataFrame, bindings: DataFrame) -> DataFrame:
    """(user_id, value) rows from enabled rules bound to user variables.

    `rules`: rule_id, variable_id, enabled; `targets`: rule_id, user_id; `bindings`: user_id,
    variable_id, value. A user without a bound value gets no row, hence no access.
    """
    active = rules.filter("enabled").join(targets, "rule_id")
    return active.join(bindings, ["user_id", "variable_id"]).select("user_id", "value").distinct()


def secure_rows(facts: DataFrame, entitled: DataFrame, column: str) -> DataFrame:
    """Every user's visible rows at once: an equi-join with the entitlement table."""
    return facts.join(entitled.withColumnRenamed("value", column), column)


def secure_totals(facts: DataFrame, entitled: DataFrame, column: str, sums: Mapping[str, str]) -> DataFrame:
    """Count and sums of every user's visible rows, per user_id: name of the result -> column summed.

    Facts are totalled per entitlement value first, so users meet one row for each of their values.
    """
    totals = facts.groupBy(F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("visible"), *[F.sum(c).alias(name) for name, c in sums.items()]
    )
    return entitled.join(totals, "value").groupBy("user_id").agg(F.sum("visible").alias("visible"), *[F.sum(n).alias(n) for n in sums])


def visible_rows(facts: DataFrame, entitled: DataFrame, column: str, user_id: str) -> DataFrame:
    """One user's visible rows, as a semi join."""
    mine = entitled.filter(F.col("user_id") == user_id).select(F.col("value").alias(column))
    return facts.join(mine, column, "left_semi")
