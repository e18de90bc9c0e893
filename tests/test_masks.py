"""Value tables and properties of the cell masks."""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import random
from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from palisade.functions import masks as m
from palisade.functions import validators as v

KEY = m.HashKey(2, b"k" * 40)


def column(spark, values, expression):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def table(spark, mask, cases):
    assert column(spark, list(cases), mask) == list(cases.values())


EMPTY = {"": "", "  ": "  ", "null": "null", " <NIL> ": " <NIL> ", None: None}


def test_phone(spark):
    table(spark, m.mask_phone("v"), {
        "13812345678": "138****5678", "+8613812345678": "138****5678", "8613812345678": "138****5678", "861381234567": "861381234567",
        "1234567": "123*4567", "1234567890": "123*7890", "123": "1**", "123456": "1*****", "12": "12", "123456789012": "123456789012",
        "　13812345678 ": "138****5678", **EMPTY})


def test_phone_strict_redacts_odd_lengths(spark):
    assert column(spark, ["12", "123456789012"], m.mask_phone("v", strict=True)) == ["[REDACTED]"] * 2


def test_email(spark):
    table(spark, m.mask_email("v"), {"a@b.c": "a***@b.c", "long.name@x@y.z": "l***@y.z", "plain": "p***", "@x.io": "@x.io", **EMPTY})


def test_idcard(spark):
    table(spark, m.mask_idcard("v"), {
        "11010519491231002x": "110105********002X", "110105194912310021": "110105********0021", "110105491231002": "110105******002",
        "1101054912310": "[REDACTED]", "x": "[REDACTED]", **EMPTY})


def test_bankcard(spark):
    table(spark, m.mask_bankcard("v"), {
        "4111 1111-1111 1111": "411111******1111", "4111111111111": "411111***1111", "411111111111": "[REDACTED]", "4111x": "[REDACTED]", **EMPTY})


def expected_ip(text):
    try:
        address = ipaddress.ip_interface(text).ip if "/" in text else ipaddress.ip_address(text)
    except ValueError:
        return "[REDACTED]"
    if address.version == 6 and address.scope_id:
        return "[REDACTED]"
    if address.version == 6 and address.ipv4_mapped:
        address = address.ipv4_mapped
    if address.version == 4:
        a, b, *_ = str(address).split(".")
        return f"{a}.{b}.*.*"
    packed = address.packed
    return f"{packed[0]:02x}{packed[1]:02x}:{packed[2]:02x}{packed[3]:02x}:****"


def ip_cases():
    rng = random.Random(7)
    cases = [
        "1.2.3.4", "01.2.3.4", "256.1.1.1", "1.2.3", "::", "::1", "1::", "2001:db8::1", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::2::3", ":::", "1:", ":1",
        "::ffff:1.2.3.4", "::ffff:102:304", "0:0:0:0:0:ffff:1.2.3.4", "0:0:0:0:0:ffff::", "0:0:0:0:0:ffff:1::", "0:0:0:0:0:FFFF::1", "fe80::1%eth0", "::1.2.3.4",
        "1:2:3:4:5:6:1.2.3.4", "::ffff:1.2.3.4/96", "10.0.0.0/8", "2001:db8::/32", "10.0.0.0/33", "::/129", "12345::", "g::", "::ffff:0:1.2.3.4", "1:2:3:4:5:6:7:8:9",
        "0::ffff:9.8.7.6", "::2:3:4:5:6:1.2.3.4", "64:ff9b::1.2.3.4",
    ]
    for _ in range(300):
        address = ipaddress.IPv6Address(rng.getrandbits(128) if rng.random() < 0.5 else rng.getrandbits(128) & rng.getrandbits(128) & rng.getrandbits(128))
        cases += [str(address), address.exploded]
        groups = [rng.choice(["0", "0", "ffff", "a1", ""]) for _ in range(rng.randint(2, 9))]
        cases.append(":".join(groups))
    return cases


def test_ip_agrees_with_the_standard_library(spark):
    cases = ip_cases()
    got = column(spark, cases, m.mask_ip("v"))
    wanted = [c if c == "" else expected_ip(c) for c in cases]
    assert [(c, g, w) for c, g, w in zip(cases, got, wanted) if g != w] == []
    valid = column(spark, cases, v.is_ip("v"))
    assert [(c, ok) for c, ok, w in zip(cases, valid, wanted) if c and ok != (w != "[REDACTED]")] == []


def test_birthdate(spark):
    table(spark, m.mask_birthdate("v"), {
        "1990-01-31": "1990-**-**", "1990/01/31": "1990-**-**", "1990.01.31": "1990-**-**", "19900131": "1990-**-**", "1990-01-31T10:00:00.5Z": "1990-**-**",
        "1990-01-31 10:00:00": "1990-**-**", "1990-02-30": "[REDACTED]", "1990-1-31": "[REDACTED]", "2000-02-29": "2000-**-**", "1900-02-29": "[REDACTED]", **EMPTY})


def test_dates_by_granularity(spark):
    values = ["2024-05-17", "2024-05", "2024", "2024-13", "20241231", "2024-05-17 01:02:03.123", "2024-05-17T01:02:03Z", "2024-05-17 1:02:03", "0000-01-01", "x"]
    r = "[REDACTED]"
    assert column(spark, values, m.mask_date("v", "year")) == ["2024", "2024", "2024", r, "2024", "2024", "2024", r, r, r]
    assert column(spark, values, m.mask_date("v", "quarter")) == ["2024Q2", "2024Q2", r, r, "2024Q4", "2024Q2", "2024Q2", r, r, r]
    assert column(spark, values, m.mask_date("v", "month")) == ["2024-05", "2024-05", r, r, "2024-12", "2024-05", "2024-05", r, r, r]


def expected_bucket(text, width, offset):
    try:
        if len(text) > 128 or "_" in text:
            return "[REDACTED]"
        exponent = int(text.lower().partition("e")[2] or 0)
        if abs(exponent) > 1000:
            return "[REDACTED]"
        value = Fraction(Decimal(text))
    except (ArithmeticError, ValueError):
        return "[REDACTED]"
    low = (value - offset) // width * width + offset
    if low < -(2**63) or low + width > 2**63 - 1:
        return "[REDACTED]"
    return f"[{low},{low + width})"


@pytest.mark.parametrize(("width", "offset"), [(10, 0), (7, 3), (1000, -250)])
def test_bucket_is_exact(spark, width, offset):
    rng = random.Random(width)
    cases = ["0", "-0", "-0.5", "12.", ".5", "1e3", "1.5E-2", "-1e-30", "9223372036854775800", "9223372036854775807", "-9223372036854775808", "1e18", "1e19", "1e1000", "1e1001", "+7", "abc", "1e", "0.1e1", "1" * 129]
    cases += [f"{rng.choice(['', '-', '+'])}{rng.randrange(10**rng.randint(1, 22))}{rng.choice(['', '.', '.0', '.000', '.25', '.999999999999'])}{rng.choice(['', '', 'e2', 'E-3', 'e-25', 'e+5'])}" for _ in range(300)]
    got = column(spark, cases, m.mask_bucket("v", width, offset))
    wanted = [expected_bucket(c, width, offset) for c in cases]
    assert [(c, g, w) for c, g, w in zip(cases, got, wanted) if g != w] == []


def test_fingerprint_is_keyed_stable_and_recognised(spark):
    values = ["alice", "alice", "bob", "é", ""]
    got = column(spark, values, m.fingerprint("v", KEY))
    expected = ["h.2." + hmac.new(KEY.material, KEY.domain + x.encode(), hashlib.sha256).hexdigest()[:32] if x else "" for x in values]
    assert got == expected
    versions = column(spark, [got[0], "h." + "a" * 32, "h.1." + "a" * 32, "h.02." + "a" * 32, "h.9999." + "0" * 32, "h.10000." + "0" * 32, "H." + "a" * 32], m.fingerprint_version("v"))
    assert versions == [2, 1, None, None, 9999, None, None]
    long_key = m.HashKey(1, b"x" * 100)
    assert column(spark, ["a"], m.fingerprint("v", long_key)) == ["h." + hmac.new(long_key.material, long_key.domain + b"a", hashlib.sha256).hexdigest()[:32]]


def test_fingerprint_without_key_is_redacted_and_short_keys_are_refused(spark):
    assert column(spark, ["a", ""], m.fingerprint("v", None)) == ["[REDACTED]", ""]
    with pytest.raises(ValueError):
        m.HashKey(1, b"short")


def test_masks_are_native_expressions(spark):
    df = spark.createDataFrame([("x",)], "v string").select(
        m.mask_phone("v"), m.mask_ip("v"), m.mask_bucket("v", 5), m.mask_date("v", "month"), m.fingerprint("v", KEY), m.mask_birthdate("v"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan


def test_id_card_checks(spark):
    import datetime as dt

    values = ["11010519491231002X", "110105194912310021", "110105491231002", "11010529991231002X", "110105491331002", "11010519491231002x"]
    assert column(spark, values, v.is_idcard("v", dt.date(2024, 1, 1))) == [True, False, True, False, False, True]


def test_birthdays_on_leap_days(spark):
    import datetime as dt

    values = ["1904-02-29", "1903-06-01", "1904-03-01", "2024-03-01", "2024-02-28", "1900-01-01"]
    assert column(spark, values, v.is_birthdate("v", dt.date(2024, 2, 29))) == [True, True, True, False, True, False]
    assert column(spark, ["1904-02-29"], v.is_birthdate("v", dt.date(2025, 2, 28))) == [True]
    assert column(spark, ["1904-02-29"], v.is_birthdate("v", dt.date(2025, 3, 1))) == [False]


def test_emails(spark):
    good = ["a@b.io", "a.b+c@x-y.co", "a'b@x.io"]
    bad = ["a@b", ".a@b.io", "a.@b.io", "a..b@c.io", "a@-b.io", "a b@c.io", "x" * 65 + "@b.io", "@b.io", "a@b@c.io"]
    assert column(spark, good + bad, v.is_email("v")) == [True] * len(good) + [False] * len(bad)


def test_unknown_number_is_never_shown(spark):
    assert column(spark, ["12", "x"], m.mask_for(F.col("v"), "number", "mask").value) == ["12", "x"]
    assert column(spark, ["12"], m.mask_for(F.col("v"), "phone", "range").value) == ["[REDACTED]"]
