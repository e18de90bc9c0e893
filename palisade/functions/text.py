"""Text helpers: Unicode trimming, empty sentinels and strict date shapes, all native expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

REDACTED = "[REDACTED]"
BLOCKED = "***"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and use it many times inside `body`."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# Fixed value: the Unicode white space characters.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def utrim(c: Column | str) -> Column:
    """Trim Unicode white space (SQL trim only removes blanks); only the ends of the text are looked at."""
    return F.btrim(as_column(c), F.lit(WHITE_SPACE))


def is_empty_value(trimmed: Column) -> Column:
    """Text that means "no value": blank, NULL or <nil> in any case."""
    return (trimmed == "") | F.upper(trimmed).isin("NULL", "<NIL>")


def all_digits(c: Column) -> Column:
    return c.rlike(r"^[0-9]+$")


@dataclass(frozen=True)
class DateParts:
    """A recognised calendar date as integer columns; `ok` is false or null when nothing matched."""

    ok: Column
    year: Column
    month: Column
    day: Column

    def as_date(self) -> Column:
        return F.when(self.ok, F.make_date(F.when(self.ok, self.year), F.when(self.ok, self.month), F.when(self.ok, self.day)))


_CLOCK = r"([01]?[0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]"
_STRICT_CLOCK = r"([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]"
_ZONE = r"(Z|[+-]([01][0-9]|2[0-4]):([0-5][0-9]|60))"
_DAY = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"

# Accepted shapes, all zero padded. Year, month and day sit at fixed offsets in each of them.
DATE_ONLY = r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{4}\.[0-9]{2}\.[0-9]{2}"
COMPACT_DATE = r"[0-9]{8}"
LOCAL_TIMESTAMP = rf"{_DAY} {_CLOCK}([.,][0-9]+)?"
ZONED_TIMESTAMP = rf"{_DAY}T{_CLOCK}([.,][0-9]+)?{_ZONE}"
STRICT_LOCAL_TIMESTAMP = rf"{_DAY} {_STRICT_CLOCK}(\.[0-9]{{1,9}})?"
STRICT_ZONED_TIMESTAMP = rf"{_DAY}T{_STRICT_CLOCK}(\.[0-9]{{1,9}})?{_ZONE}"
SLASH_TIMESTAMP = rf"[0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}} {_CLOCK}([.,][0-9]+)?"
UNZONED_T_TIMESTAMP = rf"{_DAY}T{_CLOCK}([.,][0-9]+)?"


def calendar_ok(year: Column, month: Column, day: Column) -> Column:
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    last_day = F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    return month.between(1, 12) & (day >= 1) & (day <= last_day)


def date_parts(trimmed: Column, *shapes: str) -> DateParts:
    """Match any of the given shapes and check the calendar, without exception-driven parsing."""
    shape_ok = trimmed.rlike("^(" + "|".join(f"({s})" for s in shapes) + ")$")
    compact = trimmed.rlike(f"^{COMPACT_DATE}$")
    year = F.substring(trimmed, 1, 4).try_cast("int")
    month = F.when(compact, F.substring(trimmed, 5, 2)).otherwise(F.substring(trimmed, 6, 2)).try_cast("int")
    day = F.when(compact, F.substring(trimmed, 7, 2)).otherwise(F.substring(trimmed, 9, 2)).try_cast("int")
    ok = F.coalesce(shape_ok & calendar_ok(year, month, day), F.lit(False))
    return DateParts(ok, year, month, day)
