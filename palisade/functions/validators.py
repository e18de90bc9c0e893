"""Sample validators: does a whole trimmed cell look like the given sensitive kind?"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions.netaddr import address
from palisade.functions.text import (
    COMPACT_DATE,
    DATE_ONLY,
    LOCAL_TIMESTAMP,
    SLASH_TIMESTAMP,
    UNZONED_T_TIMESTAMP,
    ZONED_TIMESTAMP,
    as_column,
    date_parts,
    utrim,
)

# Accepted e-mail shape, check weights and check letters of an 18-character ID number.
EMAIL_SHAPE = (
    r"^[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
    r"(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)+$"
)
ID_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
ID_CHECKS = "10X98765432"


def _yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def is_phone(c: Column | str) -> Column:
    return _yes(utrim(as_column(c)).rlike(r"^(\+86)?1[3-9][0-9]{9}$"))


def is_email(c: Column | str) -> Column:
    value = utrim(as_column(c))
    local_size = F.length(F.substring_index(value, "@", 1))
    return _yes(
        (F.octet_length(value) <= 254)
        & value.rlike(EMAIL_SHAPE)
        & (local_size <= 64)
        & ~value.rlike(r"^\.|\.@|\.\.[^@]*@")
    )


def is_idcard(c: Column | str, ref_date: dt.date) -> Column:
    value = F.upper(utrim(as_column(c)))
    today = F.lit(ref_date)
    short = value.rlike(r"^[0-9]{15}$")
    full = value.rlike(r"^[0-9]{17}[0-9X]$")
    birth_text = F.when(short, F.concat(F.lit("19"), F.substring(value, 7, 6))).when(full, F.substring(value, 7, 8))
    birth = date_parts(birth_text, COMPACT_DATE).as_date()
    weighted = sum(
        (F.substring(value, i + 1, 1).try_cast("int") * w for i, w in enumerate(ID_WEIGHTS)), start=F.lit(0)
    )
    expected = F.substr(F.lit(ID_CHECKS), weighted % 11 + 1, F.lit(1))
    return _yes((birth <= today) & (short | (full & (F.substring(value, 18, 1) == expected))))


def is_bankcard(c: Column | str) -> Column:
    digits = F.regexp_replace(utrim(as_column(c)), "[ -]", "")
    return _yes(digits.rlike(r"^[0-9]{13,19}$") & F.call_function("luhn_check", digits))


def is_ip(c: Column | str) -> Column:
    return _yes(address(utrim(as_column(c))).ok)


def is_birthdate(c: Column | str, ref_date: dt.date) -> Column:
    """A date not in the future and at most 120 whole years back."""
    value = utrim(as_column(c))
    parts = date_parts(value, DATE_ONLY, COMPACT_DATE, LOCAL_TIMESTAMP, ZONED_TIMESTAMP)
    born = parts.as_date()
    before_birthday = (F.lit(ref_date.month * 100 + ref_date.day)) < (parts.month * 100 + parts.day)
    # A 29 February birthday falls on 1 March in other years.
    leap_birthday = (parts.month == 2) & (parts.day == 29)
    if not _is_leap(ref_date.year):
        before_birthday = F.when(leap_birthday, F.lit(ref_date.month < 3)).otherwise(before_birthday)
    age = F.lit(ref_date.year) - parts.year - before_birthday.cast("int")
    return _yes(parts.ok & (born <= F.lit(ref_date)) & age.between(0, 120))


def _is_leap(year: int) -> bool:
    return year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)


def is_number(c: Column | str) -> Column:
    return _yes(utrim(as_column(c)).rlike(r"^[+-]?[0-9]+(?:\.[0-9]+)?$"))


def is_date_text(c: Column | str) -> Column:
    """Date or timestamp text; compact digits are never taken for dates."""
    value = utrim(as_column(c))
    parts = date_parts(value, DATE_ONLY, LOCAL_TIMESTAMP, ZONED_TIMESTAMP, SLASH_TIMESTAMP, UNZONED_T_TIMESTAMP)
    return _yes(parts.ok)


def validator(category: str, c: Column | str, ref_date: dt.date) -> Column | None:
    """The validator of a discovery category; generic has none."""
    if category == "generic":
        return None
    if category in ("idcard", "birthdate"):
        return {"idcard": is_idcard, "birthdate": is_birthdate}[category](c, ref_date)
    return {
        "phone": is_phone,
        "email": is_email,
        "bankcard": is_bankcard,
        "ip": is_ip,
        "number": is_number,
        "date": is_date_text,
    }[category](c)
