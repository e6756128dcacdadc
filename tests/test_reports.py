from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from sievecraft import CollectionSpec
from sievecraft.operators import classes
from sievecraft.plans import reports
from tests.fixtures import catalog, row, ten, tuples

WIDE = CollectionSpec("2014-01-01 00:00:00", "2025-12-31 23:59:59", malware_threshold=1)


def distribution(spark, spec, granularity):
    return tuples(
        reports.survey_distribution(ten(spark), spec, granularity), "period", "total", "malware", "cleanware"
    )


def test_golden_years(spark):
    want = [(2014, 1, 1, 0), (2016, 2, 0, 0)] + [(y, 1, 0, 1) for y in (2017, 2019, 2020, 2021, 2024, 2025)]
    assert distribution(spark, WIDE, "year") == want
    want[1] = (2016, 2, 0, 2)
    assert distribution(spark, replace(WIDE, google_play_only=False), "year") == want


def test_golden_quarters(spark):
    want = [("2014-Q2", 1, 1, 0), ("2016-Q2", 1, 0, 0), ("2016-Q4", 1, 0, 0)]
    want += [(q, 1, 0, 1) for q in ("2017-Q4", "2019-Q2", "2020-Q3", "2021-Q1", "2024-Q4", "2025-Q1")]
    assert distribution(spark, WIDE, "quarter") == want


def test_golden_summary_and_sizes(spark):
    got = tuples(reports.survey_summary(ten(spark), WIDE), "class", "available", "requested", "percentage", "short")
    assert got == [("malware", 1, 1, 100.0, True), ("cleanware", 6, 6, 100.0, True)]
    sizes = {r["class"]: r for r in reports.survey_size_estimate(ten(spark), WIDE).collect()}
    assert sizes["cleanware"].avg_bytes == pytest.approx(23587544.166666668)
    assert sizes["cleanware"].est_total_mb == pytest.approx(141525265 / 1024**2)
    assert sizes["total"].avg_bytes is None
    assert sizes["total"].est_total_mb == pytest.approx((141525265 + 1044597) / 1024**2)


def test_golden_defaults(spark):
    got = tuples(reports.survey_summary(ten(spark), CollectionSpec()), "class", "available", "percentage", "short")
    assert got == [("malware", 0, 0.0, True), ("cleanware", 1, 100.0, True)]


def test_percentage_below_hundred(spark):
    df = catalog(spark, [row(i) for i in range(8)])
    spec = CollectionSpec(n_cleanware=2, n_malware=1)
    got = {r["class"]: r for r in reports.survey_summary(df, spec).collect()}["cleanware"]
    assert (got.available, got.requested, got.percentage, got.short) == (8, 2, 25.0, False)


def edge(spark):
    return catalog(
        spark,
        [
            row(1, det=None), row(2, det=""), row(3, det="x"), row(4, det="4.5"), row(5, det="4"), row(6, det="3"),
            row(7, date="2022-04-01 00:00:00"), row(8, date="2024-12-01 00:00:00"),
            row(9, date="2024-12-01 00:00:01"), row(10, date="2022-03-31 23:59:59"), row(11, date=None),
            row(12, market="\tplay.google.com "), row(13, market="play.google.com|anzhi"),
            row(14, market="Play.Google.Com"), row(15, market=""), row(16, market=None),
            row(17, det="9", market=None), row(18, size=None), row(19, size=0),
        ],
    )


def keys(df):
    return {int(r.sha256, 16) for r in df.select("sha256").collect()}


def test_modes(spark):
    spec = CollectionSpec()
    collect = classes.base(edge(spark), spec, "collect")
    survey = classes.base(edge(spark), spec, "survey")
    assert keys(survey) == set(range(1, 20)) - {9, 10, 11}
    assert keys(collect) == keys(survey) - {1, 2, 3, 4, 16, 17}
    assert keys(classes.malware(collect, spec)) == {5}
    assert keys(classes.malware(survey, spec)) == {5, 17}
    clean = {7, 8, 12, 18, 19}
    assert keys(classes.cleanware(collect, spec)) == keys(classes.cleanware(survey, spec)) == clean
    every = replace(spec, google_play_only=False)
    assert keys(classes.cleanware(survey, every)) == clean | {13, 14, 15}


def test_flags_are_never_null(spark):
    df = classes.with_classes(classes.base(edge(spark), CollectionSpec(), "survey"), CollectionSpec())
    assert df.where(F.col("is_malware").isNull() | F.col("is_cleanware").isNull()).isEmpty()


def test_threshold_0_overlaps(spark):
    spec = CollectionSpec(malware_threshold=0)
    rows = classes.by_class(classes.base(edge(spark), spec), spec).select("class", "sha256").collect()
    sets = {c: {int(r.sha256, 16) for r in rows if r["class"] == c} for c in ("malware", "cleanware")}
    assert sets["cleanware"] < sets["malware"]


def test_typed_ntz_column_is_accepted(spark):
    df = classes.with_typed_columns(edge(spark)).withColumn("scan_ts", F.col("scan_ts").cast("timestamp_ntz"))
    assert keys(classes.base(df, CollectionSpec(), "survey")) == set(range(1, 20)) - {9, 10, 11}


def test_bad_date(spark):
    df = catalog(spark, [row(1), row(2, date="bad"), row(3, date="2022-04-01")])
    with pytest.raises(classes.BadScanDateError):
        classes.base(df, CollectionSpec(), "survey")
    assert keys(classes.base(df, CollectionSpec(), "survey", "drop")) == {1}
    assert keys(classes.base(df, CollectionSpec(), "collect")) == {1}
    with pytest.raises(classes.BadScanDateError):
        classes.base(df, CollectionSpec(), "collect", "fail")


def test_wrong_arguments(spark):
    with pytest.raises(ValueError):
        classes.base(ten(spark), CollectionSpec(), "other")
    with pytest.raises(ValueError):
        classes.base(ten(spark), CollectionSpec(), "survey", "other")


def test_missing_sizes(spark):
    df = catalog(spark, [row(1, size=None), row(2, size=None), row(3, size=None, det="9")])
    got = tuples(reports.survey_size_estimate(df, CollectionSpec()), "class", "avg_bytes", "est_total_mb")
    assert sorted(got) == [("cleanware", 0.0, 0.0), ("malware", 0.0, 0.0), ("total", None, 0.0)]


def test_null_key_is_not_counted(spark):
    df = catalog(spark, [row(None), row(1)])
    assert tuples(reports.survey_distribution(df, CollectionSpec()), "total", "cleanware") == [(1, 2)]


def test_sample_size(spark):
    rows = [("malware", 2048), ("malware", None), ("malware", 0), ("malware", -5)]
    got = tuples(reports.sample_size(spark.createDataFrame(rows, "class string, apk_size bigint")), "class", "bytes", "pretty")
    assert sorted(got) == [("cleanware", 0, "0 bytes"), ("malware", 2048, "2.00 KB"), ("total", 2048, "2.00 KB")]
