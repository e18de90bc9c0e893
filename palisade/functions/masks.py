"""Cell masks. Each returns the masked text; empty sentinels and SQL NULL pass unchanged.

`Mask.applied` is true for the cells a mask counts as masked (a blocked or fallback cell
counts, an empty or deliberately unchanged one does not).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions.hashing import check_key, hmac_sha256_hex, utf8
from palisade.functions.netaddr import address
from palisade.functions.numbers import floor_of
from palisade.functions.text import (
    BLOCKED,
    COMPACT_DATE,
    DATE_ONLY,
    LOCAL_TIMESTAMP,
    REDACTED,
    STRICT_LOCAL_TIMESTAMP,
    STRICT_ZONED_TIMESTAMP,
    ZONED_TIMESTAMP,
    as_column,
    bind,
    calendar_ok,
    date_parts,
    is_empty_value,
    utrim,
)


@dataclass(frozen=True)
class Mask:
    value: Column
    applied: Column


def _guarded(cell: Column, trimmed: Column, masked: Column, condition: Column | None = None) -> Mask:
    """Mask the non-empty cells that meet the condition; all others stay as they were."""
    hit = ~is_empty_value(trimmed)
    if condition is not None:
        hit = hit & condition
    return Mask(F.when(hit, masked).otherwise(cell), F.coalesce(hit, F.lit(False)))


def phone_mask(c: Column | str, strict: bool = False) -> Mask:
    """Odd lengths stay unchanged unless `strict`, which redacts them."""
    cell = as_column(c).cast("string")
    trimmed = utrim(cell)
    # A country prefix is dropped only when exactly eleven digits remain.
    number = F.regexp_replace(trimmed, r"^\+?86(?=[\x00-\x7F]{11}$)|^\+", "")
    size = F.length(number)
    masked = (
        F.when(size == 11, F.concat(F.substring(number, 1, 3), F.lit("****"), F.right(number, F.lit(4))))
        .when(size.between(7, 10), F.concat(F.substring(number, 1, 3), F.lit("*"), F.right(number, F.lit(4))))
        .when(size.between(3, 6), F.concat(F.substring(number, 1, 1), F.repeat(F.lit("*"), size - 1)))
        .otherwise(REDACTED)
    )
    return _guarded(cell, trimmed, masked, None if strict else size.between(3, 11))


def email_mask(c: Column | str) -> Mask:
    cell = as_column(c).cast("string")
    trimmed = utrim(cell)
    masked = F.when(
        trimmed.contains("@"),
        F.concat(F.substring(trimmed, 1, 1), F.lit("***@"), F.substring_index(trimmed, "@", -1)),
    ).otherwise(F.concat(F.substring(trimmed, 1, 1), F.lit("***")))
    return _guarded(cell, trimmed, masked, ~trimmed.rlike("^@[^@]*$"))


def idcard_mask(c: Column | str) -> Mask:
    cell = as_column(c).cast("string")
    trimmed = utrim(cell)
    masked = (
        F.when(
            trimmed.rlike(r"^[0-9]{17}[0-9Xx]$"),
            F.concat(F.substring(trimmed, 1, 6), F.lit("*" * 8), F.upper(F.right(trimmed, F.lit(4)))),
        )
        .when(trimmed.rlike(r"^[0-9]{15}$"), F.concat(F.substring(trimmed, 1, 6), F.lit("*" * 6), F.right(trimmed, F.lit(3))))
        .otherwise(REDACTED)
    )
    return _guarded(cell, trimmed, masked)


def bankcard_mask(c: Column | str) -> Mask:
    cell = as_column(c).cast("string")
    trimmed = utrim(cell)
    digits = F.regexp_replace(trimmed, "[ -]", "")
    masked = F.when(
        digits.rlike(r"^[0-9]{13,19}$"),
        F.concat(F.substring(digits, 1, 6), F.repeat(F.lit("*"), F.length(digits) - 10), F.right(digits, F.lit(4))),
    ).otherwise(REDACTED)
    return _guarded(cell, trimmed, masked)


def ip_mask(c: Column | str) -> Mask:
    cell = as_column(c).cast("string")
    trimmed = utrim(cell)
    parsed = address(trimmed)
    masked = (
        F.when(parsed.is_v4, F.concat(parsed.v4_head, F.lit(".*.*")))
        .when(parsed.is_v6, F.concat(parsed.v6_head, F.lit(":****")))
        .otherwise(REDACTED)
    )
    return _guarded(cell, trimmed, masked)


def birthdate_mask(c: Column | str) -> Mask:
    cell = as_column(c).cast("string")
    trimmed = utrim(cell)
    parts = date_parts(trimmed, DATE_ONLY, COMPACT_DATE, LOCAL_TIMESTAMP, ZONED_TIMESTAMP)
    masked = F.when(parts.ok, F.concat(F.lpad(parts.year.cast("string"), 4, "0"), F.lit("-**-**"))).otherwise(REDACTED)
    return _guarded(cell, trimmed, masked)


def block_mask(c: Column | str) -> Mask:
    cell = as_column(c).cast("string")
    return _guarded(cell, utrim(cell), F.lit(BLOCKED))


@dataclass(frozen=True)
class HashKey:
    """Key material for fingerprints. `domain` is mixed in ahead of every value."""

    version: int
    material: bytes
    domain: bytes = b"palisade:fingerprint\x00"

    def __post_init__(self) -> None:
        check_key(self.material)
        if not 1 <= self.version <= 9999:
            raise ValueError("key version must be between 1 and 9999")

    @property
    def prefix(self) -> str:
        return "h." if self.version == 1 else f"h.{self.version}."


def fingerprint_text(c: Column | str, key: HashKey) -> Column:
    message = F.concat(F.unhex(F.lit(key.domain.hex())), utf8(c))
    return F.concat(F.lit(key.prefix), F.substring(hmac_sha256_hex(key.material, message), 1, 32))


def fingerprint_mask(c: Column | str, key: HashKey | None) -> Mask:
    """Deterministic keyed fingerprint, so masked columns stay joinable; no key means redaction."""
    cell = as_column(c).cast("string")
    masked = F.lit(REDACTED) if key is None else fingerprint_text(cell, key)
    return _guarded(cell, utrim(cell), masked)


_FINGERPRINT = r"^h\.(?:([1-9][0-9]{0,3})\.)?[0-9a-f]{32}$"


def fingerprint_version(c: Column | str) -> Column:
    """Key version of a fingerprint, NULL when the text is not a fingerprint."""
    cell = as_column(c)
    digits = F.regexp_extract(cell, _FINGERPRINT, 1)
    return F.when(cell.rlike(_FINGERPRINT) & (digits != "1"), F.when(digits == "", F.lit(1)).otherwise(digits.try_cast("int")))


_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_PLAIN_NUMBER = r"^([+-]?)([0-9]{1,18})(?:\.([0-9]*))?$"

def floor_integer(trimmed: Column) -> Column:
    """floor() of decimal text as DECIMAL(22,0); no value ever passes through a double.

    NULL means not a number, or further out than any 64-bit bucket bound. Plain numbers take
    the short way; long ones and exponents have their digits shifted as text.
    """
    whole = F.concat(F.regexp_extract(trimmed, _PLAIN_NUMBER, 1), F.regexp_extract(trimmed, _PLAIN_NUMBER, 2))
    below = trimmed.startswith("-") & F.regexp_extract(trimmed, _PLAIN_NUMBER, 3).rlike("[1-9]")
    plain = (whole.try_cast("bigint") - below.cast("int")).cast("decimal(22,0)")
    is_plain = trimmed.rlike(_PLAIN_NUMBER) & (F.octet_length(trimmed) <= 128)
    return F.when(is_plain, plain).otherwise(floor_of(trimmed, trimmed.rlike(_NUMBER) & (F.octet_length(trimmed) <= 128)))


_INT64_MIN = "-9223372036854775808"
_INT64_MAX = "9223372036854775807"


def bucket_mask(c: Column | str, width: int, offset: int = 0) -> Mask:
    """`[lo,hi)` bucket text; not a number or out of the 64-bit range becomes a redaction."""
    cell = as_column(c).cast("string")
    trimmed = utrim(cell)
    if width <= 0:
        return _guarded(cell, trimmed, F.lit(REDACTED))
    step = F.lit(str(width)).cast("decimal(20,0)")
    shift = F.lit(str(offset)).cast("decimal(20,0)")
    lo_bound, hi_bound = F.lit(_INT64_MIN).cast("decimal(20,0)"), F.lit(_INT64_MAX).cast("decimal(20,0)")

    def text(low: Column) -> Column:
        high = low + step
        inside = (low >= lo_bound) & (high <= hi_bound)
        return F.coalesce(
            F.when(inside, F.concat(F.lit("["), low.cast("string"), F.lit(","), high.cast("string"), F.lit(")"))),
            F.lit(REDACTED),
        )

    low = bind(floor_integer(trimmed), lambda value: (value - F.pmod(value - shift, step)).cast("decimal(24,0)"))
    return _guarded(cell, trimmed, bind(low, text))


GRANULARITIES = ("year", "quarter", "month")


def date_mask(c: Column | str, granularity: str) -> Mask:
    """Truncate a date text to its year, quarter or month; coarser input than asked is redacted."""
    if granularity not in GRANULARITIES:
        raise ValueError(f"granularity must be one of {GRANULARITIES}")
    cell = as_column(c).cast("string")
    trimmed = utrim(cell)
    only_year = trimmed.rlike(r"^[0-9]{4}$")
    year_month = trimmed.rlike(r"^[0-9]{4}-[0-9]{2}$")
    full = date_parts(trimmed, DATE_ONLY, COMPACT_DATE, STRICT_LOCAL_TIMESTAMP, STRICT_ZONED_TIMESTAMP)
    year = F.when(only_year | year_month | full.ok, F.substring(trimmed, 1, 4).try_cast("int"))
    month = F.when(year_month, F.substring(trimmed, 6, 2).try_cast("int")).when(full.ok, full.month)
    month_ok = ~year_month | calendar_ok(year, month, F.lit(1))
    in_range = month_ok & (year >= 1)
    year_text = F.lpad(year.cast("string"), 4, "0")
    if granularity == "year":
        shown = year_text
    elif granularity == "quarter":
        shown = F.when(~only_year, F.concat(year_text, F.lit("Q"), F.floor((month - 1) / 3 + 1).cast("string")))
    else:
        shown = F.when(~only_year, F.concat(year_text, F.lit("-"), F.lpad(month.cast("string"), 2, "0")))
    return _guarded(cell, trimmed, F.coalesce(F.when(in_range, shown), F.lit(REDACTED)))


def _value(fn):
    def masked(c, *args, **kwargs):
        return fn(c, *args, **kwargs).value

    masked.__name__ = fn.__name__.replace("_mask", "")
    masked.__doc__ = fn.__doc__
    return masked


mask_phone = _value(phone_mask)
mask_email = _value(email_mask)
mask_idcard = _value(idcard_mask)
mask_bankcard = _value(bankcard_mask)
mask_ip = _value(ip_mask)
mask_birthdate = _value(birthdate_mask)
mask_block = _value(block_mask)
mask_bucket = _value(bucket_mask)
mask_date = _value(date_mask)
fingerprint = _value(fingerprint_mask)


# Sensitive types in their deciding order, and mask algorithms.
SENSITIVE_TYPES = ("phone", "email", "idcard", "bankcard", "ip", "birthdate", "generic", "number", "date")
ALGORITHMS = ("mask", "hash", "block", "range")

_FORMAT_MASKS = {
    "phone": phone_mask,
    "email": email_mask,
    "idcard": idcard_mask,
    "bankcard": bankcard_mask,
    "ip": ip_mask,
    "birthdate": birthdate_mask,
}


def mask_for(
    c: Column | str,
    sensitive_type: str,
    algorithm: str,
    key: HashKey | None = None,
    width: int | None = None,
    offset: int = 0,
    granularity: str | None = None,
) -> Mask:
    """The mask a rule asks for. Types without a format mask leave the cell unchanged."""
    cell = as_column(c).cast("string")
    if algorithm == "range":
        if sensitive_type == "number":
            return bucket_mask(cell, width or 0, offset or 0)
        if sensitive_type == "date":
            return date_mask(cell, granularity or "month")
        return Mask(F.lit(REDACTED), F.lit(True))
    if algorithm == "hash":
        return fingerprint_mask(cell, key)
    if algorithm == "block":
        return block_mask(cell)
    if algorithm == "mask" and sensitive_type in _FORMAT_MASKS:
        return _FORMAT_MASKS[sensitive_type](cell)
    return Mask(cell, F.lit(False))
