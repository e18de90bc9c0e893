"""Keyed and unkeyed digests, TLV framing and order-free set digests as native expressions."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions.text import as_column

_BLOCK = 64
MIN_KEY_BYTES = 32


def _hex_literal(raw: bytes) -> Column:
    return F.unhex(F.lit(raw.hex()))


def hmac_sha256_hex(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 of a binary column, lower-case hex."""
    padded = (hashlib.sha256(key).digest() if len(key) > _BLOCK else key).ljust(_BLOCK, b"\0")
    inner = bytes(b ^ 0x36 for b in padded)
    outer = bytes(b ^ 0x5C for b in padded)
    inner_hash = F.unhex(F.sha2(F.concat(_hex_literal(inner), message), 256))
    return F.sha2(F.concat(_hex_literal(outer), inner_hash), 256)


def check_key(key: bytes) -> None:
    if len(key) < MIN_KEY_BYTES:
        raise ValueError(f"key material needs at least {MIN_KEY_BYTES} bytes")


def utf8(c: Column | str) -> Column:
    return F.encode(as_column(c), "UTF-8")


# Fixed TLV tags: nil, text, int, bytes.
TAG_NIL, TAG_TEXT, TAG_INT, TAG_BYTES = "00", "01", "02", "03"


def _tlv(tag: str, payload: Column) -> Column:
    length = F.unhex(F.lpad(F.hex(F.octet_length(payload)), 8, "0"))
    return F.concat(F.unhex(F.lit(tag)), length, payload)


def tlv_text(c: Column | str) -> Column:
    return F.coalesce(_tlv(TAG_TEXT, utf8(as_column(c).cast("string"))), F.unhex(F.lit(TAG_NIL + "0" * 8)))


def tlv_int(c: Column | str) -> Column:
    return F.coalesce(_tlv(TAG_INT, utf8(as_column(c).cast("bigint").cast("string"))), F.unhex(F.lit(TAG_NIL + "0" * 8)))


def tlv_bytes(c: Column) -> Column:
    return _tlv(TAG_BYTES, c)


def row_digest(columns: Sequence[str]) -> Column:
    """SHA-256 over the TLV text form of the named columns; NULL differs from ''."""
    return F.sha2(F.concat(*[tlv_text(c) for c in columns]), 256)


_WORDS = 8
_WORD_HEX = 6


def set_digest(digest: Column) -> Column:
    """Order-free digest of many row digests: sums of hash words, so it aggregates map-side.

    Duplicated rows change the sums (an XOR would cancel them out). Each word has 24 bits, so
    a plain 64-bit sum holds for 5 * 10^11 rows.
    """
    sums = [
        F.coalesce(
            F.sum(F.conv(F.substring(digest, 1 + i * _WORD_HEX, _WORD_HEX), 16, 10).cast("bigint")), F.lit(0).cast("bigint")
        ).cast("string")
        for i in range(_WORDS)
    ]
    return F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *sums), 256)
