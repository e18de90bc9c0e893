"""IP and CIDR text as native expressions: validity, leading bytes, and v4-mapped addresses.

Only the first 32 bits are ever shown, so patterns read them straight from the text: what
'::' stands for matters only when it comes first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_V4_CELL = rf"^{_V4}(?:/(?:3[0-2]|[12]?[0-9]))?$"

_H = "[0-9a-fA-F]{1,4}"
_TAIL = rf"(?:{_H}:{_H}|{_V4})"  # the last 32 bits, as two groups or dotted
# Eight groups without '::', or '::' with up to seven groups around it.
_V6 = "|".join(
    [rf"(?:{_H}:){{6}}{_TAIL}"]
    + [
        (rf"{_H}(?::{_H}){{{left - 1}}}" if left else "") + "::" + right
        for left in range(8)
        for right in (
            [rf"(?:(?:{_H}:){{0,{5 - left}}}{_TAIL}|{_H})?"] if left <= 5 else [rf"(?:{_H})?"] if left == 6 else [""]
        )
    ]
)
_V6_CELL = rf"^(?:{_V6})(?:/(?:12[0-8]|1[01][0-9]|[1-9]?[0-9]))?$"

# v4-mapped forms: five zero groups, ffff, then 32 bits.
_MAPPED_DOTTED = rf"^[0:]+:[fF]{{4}}:({_OCTET})\.({_OCTET})\."
_MAPPED_GROUPS = rf"^[0:]+:[fF]{{4}}:({_H}):{_H}(?:/|$)"
_MAPPED_TRAILING_GAP = r"^(?:0{1,4}:){5}[fF]{4}:([0-9a-fA-F]{0,4})::?[0-9a-fA-F]{0,4}(?:/|$)"
_SEVEN_AFTER_GAP = rf"^::({_H})(?::{_H}){{6}}(?:/|$)"
_SEVEN_AFTER_GAP_DOTTED = rf"^::({_H})(?::{_H}){{4}}:{_OCTET}\."


@dataclass(frozen=True)
class Address:
    """`is_v4` and `is_v6` never hold together; `first`..`second` are the leading bytes or hextets."""

    is_v4: Column
    is_v6: Column
    v4_head: Column
    v6_head: Column

    @property
    def ok(self) -> Column:
        return self.is_v4 | self.is_v6


def _hextet(text: Column) -> Column:
    return F.lpad(F.lower(text), 4, "0")


def address(trimmed: Column) -> Address:
    """Read one trimmed cell. Zones and malformed text match neither family."""
    plain_v4 = trimmed.rlike(_V4_CELL)
    any_v6 = trimmed.contains(":") & trimmed.rlike(_V6_CELL)
    mapped = any_v6 & (
        trimmed.rlike(_MAPPED_DOTTED) | trimmed.rlike(_MAPPED_GROUPS) | trimmed.rlike(_MAPPED_TRAILING_GAP)
    )
    mapped_group = F.concat(
        F.regexp_extract(trimmed, _MAPPED_GROUPS, 1), F.regexp_extract(trimmed, _MAPPED_TRAILING_GAP, 1)
    )
    mapped_hex = F.lpad(mapped_group, 4, "0")
    mapped_head = F.when(
        trimmed.rlike(_MAPPED_DOTTED),
        F.concat(F.regexp_extract(trimmed, _MAPPED_DOTTED, 1), F.lit("."), F.regexp_extract(trimmed, _MAPPED_DOTTED, 2)),
    ).otherwise(
        F.concat(
            F.conv(F.substring(mapped_hex, 1, 2), 16, 10), F.lit("."), F.conv(F.substring(mapped_hex, 3, 2), 16, 10)
        )
    )
    after_gap = F.concat(
        F.regexp_extract(trimmed, _SEVEN_AFTER_GAP, 1), F.regexp_extract(trimmed, _SEVEN_AFTER_GAP_DOTTED, 1)
    )
    first = F.regexp_extract(trimmed, f"^({_H}):", 1)
    second = F.regexp_extract(trimmed, f"^{_H}:({_H})", 1)
    v6_head = F.concat(_hextet(first), F.lit(":"), _hextet(F.when(first == "", after_gap).otherwise(second)))
    return Address(
        is_v4=F.coalesce(plain_v4 | mapped, F.lit(False)),
        is_v6=F.coalesce(any_v6 & ~mapped, F.lit(False)),
        v4_head=F.when(plain_v4, F.substring_index(trimmed, ".", 2)).otherwise(mapped_head),
        v6_head=v6_head,
    )
