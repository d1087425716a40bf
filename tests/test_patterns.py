"""Patterns in RE2 syntax and layouts by example; expected values are derived by reading the rules."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from mediacat.functions import dates as D
from mediacat.functions.patterns import PatternError, compiles, to_java

TEXTS = [
    "IMG_20190509_154733.jpg", "a\nb", "a\n", "\n", "", "x[12345678", "aXbxc", "straße_KK", "Ωmega_1", "a\u000bb c\td", "a-b]c", "(a)+{2}", "aaa", "ab12ab34", "tab\\d", " a", "ſs", "x\r", "a&&b", "0a0",
]
PATTERNS = [
    r"(?P<a_b>[0-9]{8})", r"[^[]([0-9]{8})", r"\pL+_([0-9]{8})", r"([0-9]+)\.jpg\z", r"[[:alpha:]]+", r"[[:^alpha:]]+", r"a.", r"(?s)a.", r"a$", r"(?m)^b$", r"(?m)^", r"$", r"\s", r"[\s]+", r"\S+", r"[^\S]", r"(?i)k+", r"(?i)[s]+", r"\bb", r"\Ba",
    r"a{2}", r"a{2", r"a{,2}", r"a+?", r"(?U)a+", r"(?U)a+?", r"(?i:x)b(?-i:x)", r"[a-]+", r"[]a]+", r"[^]a]+", r"\Q(a)+\E", r"\Qa+", r"\x{3A9}", r"\x41|\101|\x58", r"\p{Greek}", r"\P{Greek}+", r"\p{^Lu}+", r"[\p{Lu}\d]+", r"[^\p{L}]+", r"[&&b]+", r"[a\]-]+", r"(a|ab)(12)?", r"(?:ab(\d+))+", r"\v", r"a|", r"\_", r"\.", r"[\w.]+", r"[\D]+", r"()a", r"x*", r"\A\w", r"\a|\f|\t",
]
REJECTED = ["(", ")", "*a", "a**", "a*+", "a{2}{3}", "(?=a)", "(?<=a)b", r"(a)\1", "a{1001}", "a{3,2}", "[b-a]", "[a", r"\Z", "(?P<x>a)(?P<x>b)", "(?z)a", "a\\", r"\pX", r"\p{Alphabetic}", "[[:nope:]]", r"\8", "(?)", "(?i-)", r"\C"]


def test_patterns_agree_with_re2(spark):
    """DuckDB runs RE2 itself."""
    con = duckdb.connect()
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "i int, x string")
    columns = []
    for n, p in enumerate(PATTERNS):
        java, groups = to_java(p)
        assert compiles(java), (p, java)
        columns.append(F.when(F.col("x").rlike(java), F.regexp_extract("x", java, min(groups, 1))).alias(f"p{n}"))
    got = {r["i"]: r for r in texts.select("i", *columns).collect()}
    for n, p in enumerate(PATTERNS):
        group = min(to_java(p)[1], 1)
        for i, x in enumerate(TEXTS):
            want = con.execute(f"SELECT CASE WHEN regexp_matches(?, ?) THEN regexp_extract(?, ?, {group}) END", [x, p, x, p]).fetchone()[0]
            assert got[i][f"p{n}"] == want, (p, x)


def test_what_re2_rejects_is_passed_over(spark):
    for p in REJECTED:
        try:
            java, _ = to_java(p)
            assert not compiles(java), p
        except PatternError:
            pass
        assert not D.CustomPattern(p, "2006").usable(), p
    assert D.CustomPattern(r"(?P<a_b>[0-9]{8})", "20060102").usable()
    names = spark.createDataFrame([("IMG[20190203.jpg",), ("x",)], "name string")
    patterns = [*[D.CustomPattern(p, "20060102") for p in REJECTED], D.CustomPattern(r"([0-9]{8})\.jpg\z", "20060102")]
    assert [r[0] for r in names.select(D.custom_date(F.col("name"), patterns).cast("string")).collect()] == ["2019-02-03 00:00:00", None]


LAYOUTS = [
    ("2006-01-02 15:04:05", "2019-02-03 04:05:06", "2019-02-03 04:05:06"), ("2006-01-02 15:04:05", "2019-02-03 4:05:06", "2019-02-03 04:05:06"), ("2006-01-02 15:04:05", "2019-02-03 04:05:06.25", "2019-02-03 04:05:06.25"),
    ("2006-01-02 15:04:05.000", "2019-02-03 04:05:06.123", "2019-02-03 04:05:06.123"), ("2006-01-02 15:04:05.000", "2019-02-03 04:05:06.12", None), ("2006-01-02 15:04:05,999", "2019-02-03 04:05:06,1234567", "2019-02-03 04:05:06.123456"), ("15:04:05.999", "04:05:06", "0000-01-01 04:05:06"),
    ("Jan _2 2006", "feb  3 2019", "2019-02-03 00:00:00"), ("Jan _2 2006", "Feb 13 2019", "2019-02-13 00:00:00"), ("January 2, 2006", "march 3, 2019", "2019-03-03 00:00:00"), ("January 2, 2006", "mar 3, 2019", None), ("Monday 02-Jan-06", "Sunday 03-Feb-69", "1969-02-03 00:00:00"), ("02-Jan-06", "03-Feb-68", "2068-02-03 00:00:00"),
    ("2006.002", "2020.366", "2020-12-31 00:00:00"), ("2006.002", "2019.366", None), ("2006 002 01", "2019 040 02", "2019-02-09 00:00:00"), ("2006 002 01", "2019 040 03", None), ("2006 __2", "2019  40", "2019-02-09 00:00:00"),
    ("3:04PM 2006", "12:05AM 2019", "2019-01-01 00:05:00"), ("3:04PM 2006", "12:05PM 2019", "2019-01-01 12:05:00"), ("03:04pm 2006", "01:05pm 2019", "2019-01-01 13:05:00"), ("03:04pm 2006", "01:05PM 2019", None), ("3PM", "13PM", None),
    ("2006-01-02T15:04:05Z07:00", "2019-02-03T04:05:06Z", "2019-02-03 04:05:06"), ("2006-01-02T15:04:05Z07:00", "2019-02-03T04:05:06-01:30", "2019-02-03 05:35:06"), ("2006-01-02T15:04:05-0700", "2019-02-03T04:05:06+0130", "2019-02-03 02:35:06"), ("2006-01-02 -07", "2019-02-03 Z", None),
    ("2006-01-02 15:04 MST", "2019-02-03 04:05 UTC", "2019-02-03 04:05:00"), ("2006-01-02 15:04 MST", "2019-02-03 04:05 GMT+2", "2019-02-03 02:05:00"), ("2006-01-02 15:04 MST", "2019-02-03 04:05 CEST", "2019-02-03 04:05:00"), ("2006-01-02 15:04 MST", "2019-02-03 04:05 ABCD", None),
    ("2006-01-02", "2019-02-29", None), ("2006-01-02", "2019-13-01", None), ("2006-01-02", "2019-02-03x", None), ("2006-01-02 15", "2019-02-03 24", None), ("15:04", "04:60", None), ("at 2006", "at   2019", "2019-01-01 00:00:00"), ("2006 x", "2019", None), ("20060102_150405", "20190203_040506", "2019-02-03 04:05:06"), ("Janet 2006", "Janet 2019", "2019-01-01 00:00:00"), ("[2006]'x'", "[2019]'x'", "2019-01-01 00:00:00"),
]


@pytest.mark.parametrize("zone", ["UTC", "Europe/Berlin"])
def test_layouts_by_example(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        for layout, text, want in LAYOUTS:
            got = spark.createDataFrame([(text,)], "x string").select(D.layout_date(F.col("x"), layout).cast("string")).first()[0]
            if zone == "UTC":
                assert got == want, (layout, text)
            else:
                assert (got is None) == (want is None) and (got == want or any(e in layout for e in ("07", "MST"))), (layout, text)
                if text.endswith("CEST"):
                    assert got == "2019-02-03 05:05:00"  # not the zone's name in winter, so it counts as UTC
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
