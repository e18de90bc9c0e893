"""Decimal text handled digit by digit, so that no value passes through a double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions.text import bind

_MAX_INT_DIGITS = 20
MAX_EXPONENT = 1000


def shifted(trimmed: Column, accepted: Column) -> Column:
    """Whole and fraction digits of a number text after applying its exponent, as a struct.

    `kept` are the whole digits without leading zeros, `dropped` the fraction digits; both NULL
    where the text is not accepted, or its exponent is beyond +-1000.
    """
    mantissa = F.regexp_replace(trimmed, r"^[+-]|[eE].*$", "")
    exponent = F.coalesce(F.nullif(F.regexp_extract(trimmed, r"[eE]([+-]?[0-9]+)$", 1), F.lit("")), F.lit("0")).try_cast("bigint")
    shape = F.struct(
        F.regexp_replace(mantissa, r"\.", "").alias("digits"),
        F.when(
            accepted & exponent.between(-MAX_EXPONENT, MAX_EXPONENT), F.length(F.substring_index(mantissa, ".", 1)) + exponent
        ).cast("int").alias("point"),
    )

    def cut(s: Column) -> Column:
        digits, point = s["digits"], s["point"]
        whole = F.when(point <= 0, "").when(point.isNotNull(), F.rpad(F.substr(digits, F.lit(1), point), point, F.lit("0")))
        fraction = F.when(point <= 0, F.concat(F.repeat(F.lit("0"), -point), digits)).when(
            point.isNotNull(), F.substr(digits, point + 1)
        )
        return F.struct(F.regexp_replace(whole, "^0+", "").alias("kept"), fraction.alias("dropped"))

    return bind(shape, cut)


def whole_part(digits: Column) -> Column:
    """Up to twenty whole digits as a decimal; longer ones are beyond any 64-bit value."""
    return F.when(F.length(digits) <= _MAX_INT_DIGITS, F.concat(F.lit("0"), digits).try_cast("decimal(21,0)"))


def floor_of(trimmed: Column, accepted: Column) -> Column:
    def assemble(s: Column) -> Column:
        size = whole_part(s["kept"])
        below = F.when(s["dropped"].rlike("[1-9]"), 1).otherwise(0).cast("decimal(1,0)")
        return F.when(trimmed.startswith("-"), -size - below).otherwise(size).cast("decimal(22,0)")

    return bind(shifted(trimmed, accepted), assemble)


def half_away_of(trimmed: Column, accepted: Column) -> Column:
    """Rounded to a whole number, halves away from zero."""

    def assemble(s: Column) -> Column:
        up = F.when(s["dropped"].rlike("^[5-9]"), 1).otherwise(0).cast("decimal(1,0)")
        size = (whole_part(s["kept"]) + up).cast("decimal(22,0)")
        return F.when(trimmed.startswith("-"), -size).otherwise(size)

    return bind(shifted(trimmed, accepted), assemble)
