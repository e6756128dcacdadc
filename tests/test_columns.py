import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievecraft.functions import columns as C


def values(spark, items, dtype, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v")).alias("x")).collect()]


def test_detection(spark):
    items = ["0", "12", None, "", "x", "4.5", "-1", "99999999999999999999", " 7 "]
    assert values(spark, items, "string", C.parse_detection) == [0, 12, None, None, None, None, -1, None, 7]


DATES = {
    "2022-04-01 00:00:00": True,
    "2024-02-29 23:59:59": True,
    "2023-02-29 00:00:00": False,
    "2022-04-01": False,
    "2022-04-01 00:00:00.5": False,
    "2022-4-1 0:0:0": False,
    "2022-04-01T00:00:00": False,
    "2022-04-01 00:00:00Z": False,
    "2022-04-01 00:00:00\n": False,
    " 2022-04-01 00:00:00": False,
    "2022-13-01 00:00:00": False,
    "2022-04-01 24:00:00": False,
    "bad": False,
    "": False,
}


def test_scan_date(spark):
    text = lambda c: F.date_format(C.parse_scan_date(c), C.SCAN_DATE_PATTERN)
    got = values(spark, list(DATES), "string", text)
    assert got == [d if ok else None for d, ok in DATES.items()]
    assert values(spark, [None], "string", text) == [None]


def test_scan_date_agrees_with_the_pattern_parser(spark):
    both = lambda c: C.parse_scan_date(c).eqNullSafe(
        F.try_to_timestamp(c, F.lit(C.SCAN_DATE_PATTERN))
    )
    assert all(values(spark, list(DATES), "string", both))


def test_lenient_window_takes_one_digit(spark):
    texts = ["2023-4-1 0:0:0", "2023-04-01 00:00:00", "2023-13-1 0:0:0", "2023-2-30 0:0:0", "2023-4-1", "", None, "23-4-1 0:0:0"]
    df = spark.createDataFrame([(t,) for t in texts], "d string")
    inside = C.is_within_date_range(F.col("d"), "2023-01-01 00:00:00", "2023-12-31 23:59:59")
    assert [r.x for r in df.select(inside.alias("x")).collect()] == [True, True] + [False] * 6


def test_strict_scan_date(spark):
    assert len(values(spark, ["2022-04-01 00:00:00", None], "string", lambda c: C.parse_scan_date(c, True))) == 2
    with pytest.raises(Exception, match="CANNOT_PARSE_TIMESTAMP"):
        values(spark, ["bad"], "string", lambda c: C.parse_scan_date(c, True))


def test_market(spark):
    items = ["\tplay.google.com ", "play.google.com\n", " play.google.com", "play.google.com|anzhi",
             "Play.Google.Com", "", None]
    assert values(spark, items, "string", C.is_play_market) == [True, True, True, False, False, False, None]
    assert values(spark, [" a b "], "string", C.trimmed_market) == ["a b"]


@pytest.mark.parametrize("granularity, want", [("year", 2021), ("quarter", "2021-Q1"), ("month", "2021-03")])
def test_period(spark, granularity, want):
    period = lambda c: C.period(c.cast("timestamp"), granularity)
    assert values(spark, ["2021-03-31 23:59:59", None], "string", period) == [want, None]


def python_size(n):
    for name, unit in (("GB", 1024**3), ("MB", 1024**2), ("KB", 1024)):
        if n >= unit:
            return f"{n / unit:.2f} {name}"
    return f"{n} bytes"


def test_size_examples(spark):
    items = [0, 1023, 1024, 1152, 1408, 1048575, 1048576, 1024**3 - 1, 1024**3, 141525265, 1044597, 2**53 - 1]
    assert values(spark, items, "bigint", C.format_size) == [python_size(n) for n in items]
    assert values(spark, [None], "bigint", C.format_size) == [None]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 2**52), min_size=50, max_size=200))
def test_size_like_python(spark, items):
    items = items + [n % 2**21 for n in items] + [n % 2**31 // 128 * 128 for n in items]
    assert values(spark, items, "bigint", C.format_size) == [python_size(n) for n in items]


def test_target_path(spark):
    path = lambda c: C.target_path(F.lit("malware"), c)
    assert values(spark, ["AB12", "", None], "string", path) == ["malware/ab12.apk", None, None]


def test_row_predicates(spark):
    items = [None, "", "x", "4", "3", "-1"]
    assert values(spark, items, "string", C.has_detection) == [False, False, True, True, True, True]
    assert values(spark, items, "string", lambda c: C.is_malware_lenient(c, 4)) == [
        False, False, False, True, False, False,
    ]
    # nothing counts as -1, which no threshold from 0 on reaches
    assert values(spark, items, "string", lambda c: C.is_malware_lenient(c, 0)) == [
        False, False, False, True, True, False,
    ]
    dates = ["2022-04-01 00:00:00", "2022-04-02 00:00:00", "2022-04-02 00:00:01", "bad", None]
    within = lambda c: C.is_within_date_range(c, "2022-04-01 00:00:00", "2022-04-02 00:00:00")
    assert values(spark, dates, "string", within) == [True, True, False, False, False]
