from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tabsight.functions import cells as C

NUMBERS = [
    ("$1,234.50", 1234.5), ("(12)", -12.0), ("50%", 0.5), ("(50%)", -0.5), ("(50)%", None), ("(-5)", 5.0),
    ("1e5", 1e5), ("1.5.2", None), ("2026-01-01", None), ("2026/01/02", 20260102.0), ("Jan 01 2026", 12026.0),
    ("Feb 01 2026", None), ("Brand#12", 12.0), ("Order#12", None), ("12:30", 1230.0), ("1.234,56", 1.23456),
    ("5-", None), (" 7 ", 7.0), ("True", None), ("()", None), ("n/a", None), (None, None), ("1d", 1.0),
    ("Infinity", None), ("x" * 5000 + "9", 9.0), ("the end 9", None),
]

DATES = [
    ("2026-01-02", datetime(2026, 1, 2)), ("2026-1-2", datetime(2026, 1, 2)), ("2026/1/2", datetime(2026, 1, 2)),
    ("1/2/2026", datetime(2026, 1, 2)), ("13/1/2026", datetime(2026, 1, 13)), ("jan 2 2026", datetime(2026, 1, 2)),
    ("March 02 2026", datetime(2026, 3, 2)), ("2026-01-02T03:04:05Z", datetime(2026, 1, 2, 3, 4, 5)),
    ("2026-01-02 03:04:05", datetime(2026, 1, 2, 3, 4, 5)), ("2026-01-02T03:04:05-05:30", datetime(2026, 1, 2, 8, 34, 5)),
    ("20260102", datetime(2026, 1, 2)), ("20260102T0304", datetime(2026, 1, 2, 3, 4)),
    ("2026-01-02T03:04:05,25", datetime(2026, 1, 2, 3, 4, 5, 250000)), ("may  3   2026", datetime(2026, 5, 3)),
    ("2026-01-02T", None), ("2026-01-02 garbage", None), ("Sept 02 2026", None), ("13/13/2026", None),
    ("2 Jan 2026", None), ("2026", None), ("2026-01", None), ("12:30", None), ("1/2/26", None), ("2026-02-30", None),
    ("null", None),
]

BOOLEANS = [
    ("t", True), ("T", True), ("yes", True), (" Y ", True), ("1", True), ("f", False), ("No", False), ("0", False),
    ("maybe", None), ("10", None), ("none", None),
]

MISSING = [
    ("", True), (" NA ", True), ("n/a", True), ("NULL", True), ("none", True), ("NaN", True), ("-", True), ("--", True),
    ("\t", True), (" na ", True), (None, True), ("0", False), ("---", False), ("nan x", False), (" " * 500 + "x", False),
]


def check(spark, cases, expression):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, s string")
    rows = df.select("i", "s", expression(F.col("s")).alias("v")).collect()
    wrong = [(r["s"], r["v"], cases[r["i"]][1]) for r in rows if r["v"] != cases[r["i"]][1]]
    assert not wrong


def test_parse_number(spark):
    check(spark, NUMBERS, C.parse_number)


def test_parse_date(spark):
    check(spark, DATES, C.parse_date)


def test_parse_boolean(spark):
    check(spark, BOOLEANS, C.parse_boolean)


def test_is_missing(spark):
    check(spark, MISSING, C.is_missing)


def test_week_dates_and_wide_offsets(spark):
    from datetime import datetime, timezone

    texts = [
        "2026-W01", "2026-W01-1", "2026W017", "2020-W53-7", "2021-W53-1", "2026-W00-1", "2026-W54", "2026-W01-8",
        "2026-W10-3T04:05:06", "2026W103T040506+0530", "2026-01-02T03:04:05+23:59", "2026-01-02T03:04:05-19:00",
        "2026-01-02T03:04:05+24:00", "2026-01-02T03:04:05-05:30", "2026-01-02T03:04:05Z", "2026-01-02T03:04:05+19",
    ]

    def expected(text):
        try:
            when = datetime.fromisoformat(text)
        except ValueError:
            return None
        return when if when.tzinfo is None else when.astimezone(timezone.utc).replace(tzinfo=None)

    rows = spark.createDataFrame([(t,) for t in texts], "s string").select("s", C.parse_date(F.col("s")).alias("t").cast("string")).collect()
    got = {r["s"]: r["t"] for r in rows}
    assert got == {t: str(e) if (e := expected(t)) else None for t in texts}


def test_strict_numbers_refuse_dates_and_names(spark):
    cases = [("2026/01/02", None), ("Brand#12", None), ("$1,234.5", 1234.5), ("(50%)", -0.5), ("-3", -3.0)]
    check(spark, cases, lambda c: C.parse_number(c, strict=True))


@pytest.mark.parametrize("case", ["lower", "upper", "title"])
def test_normalize_text(spark, case):
    texts = ["It's O-neil 3rd", " a  b\tc ", "ÉCOLE élan", "3rd x2y"]
    expected = [(t, getattr(" ".join(t.split()), case)()) for t in texts]
    check(spark, expected, lambda c: C.normalize_text(c, case))


def test_title_reads_the_cell_once(spark):
    texts = ["o'neil-smith 4th\tx2Y", "\U0001f600a\U00010428B\U0001f600", "ⓐⓐ aⓐB", "", " \n "]
    df = spark.createDataFrame([(t,) for t in texts], "s string").select(C.normalize_text(F.col("s"), "title").alias("t"))
    assert [r["t"] for r in df.collect()] == ["O'Neil-Smith 4Th X2Y", "\U0001f600A\U00010428b\U0001f600", "ⒶⒶ AⓐB", "", ""]
    # A lambda that named the whole cell would collapse it again for each of its characters.
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_replace(") == 1


def test_typed_columns(spark):
    df = spark.createDataFrame(
        [(1, float("nan"), True, datetime(2026, 1, 1)), (0, 1.0, None, None)], "i int, d double, b boolean, t timestamp"
    )
    rows = df.select(
        C.parse_boolean(F.col("i"), "integral").alias("ib"),
        C.parse_number(F.col("d"), "floating").alias("dn"),
        C.is_missing(F.col("d"), "floating").alias("dm"),
        C.parse_boolean(F.col("d"), "floating").alias("db"),
        C.parse_number(F.col("b"), "boolean").alias("bn"),
        C.text_of(F.col("b"), "boolean").alias("bt"),
        C.parse_date(F.col("t"), "temporal").alias("td"),
    ).collect()
    assert rows[0] == (True, None, False, None, None, "True", datetime(2026, 1, 1))
    assert rows[1] == (False, 1.0, False, None, None, None, None)
