import re

import pytest
from pyspark.sql import functions as F

from sievecraft import CollectionSpec
from sievecraft.operators import classes
from sievecraft.plans import incremental, reports
from sievecraft.sources import catalog as source
from tests.fixtures import TEN, csv_text, row

SPECS = [
    CollectionSpec("2014-01-01 00:00:00", "2025-12-31 23:59:59", malware_threshold=1),
    CollectionSpec("2016-06-15 15:26:44", "2020-07-13 07:37:26", malware_threshold=0, google_play_only=False),
    CollectionSpec("2019-06-25 08:00:00", "2019-06-25 09:00:00", malware_threshold=4),
    CollectionSpec("2014-04-27 00:00:00", "2019-06-25 08:55:41", malware_threshold=100),
    CollectionSpec("2030-01-01 00:00:00", "2031-01-01 00:00:00"),
]


def rows_of(seed, n):
    days = ["2016-06-15 15:26:43", "2016-06-15 15:26:44", "2019-06-25 08:30:00", "2019-06-25 23:59:59", "2020-07-13 07:37:26", "2018-02-28 00:00:00", None]
    dets = ["0", "1", "4", "99", "100", "250", "-3", None, "x", "0"]
    markets = ["play.google.com", " play.google.com\t", "anzhi", None, "play.google.com|anzhi"]
    return [
        row(1000 * seed + i, size=None if i % 9 == 0 else 100 + i, det=dets[(i + seed) % 10], date=days[(i * seed) % 7], market=markets[i % 5])
        for i in range(n)
    ] + [row(None, det="0", date="2019-06-25 08:30:00")]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "csv").mkdir()
    for seed in (1, 2, 3):
        (tmp_path / "csv" / f"{seed}.csv").write_text(csv_text(rows_of(seed, 70)))
    (tmp_path / "csv" / "ten.csv").write_text(csv_text([row(i, *values) for i, values in enumerate(TEN, 1)]))
    return tmp_path


def compare(spark, table, specs=SPECS):
    full = source.read_table(spark, table)
    for spec in specs:
        for mode in classes.MODES:
            got = incremental.survey_overview(spark, table, spec, mode).collect()
            want = reports.survey_overview(full, spec, mode).collect()
            assert [r[:5] for r in got] == [r[:5] for r in want]
            assert all(g[i] == pytest.approx(w[i]) for g, w in zip(got, want) for i in (5, 6))
        got = incremental.survey_distribution(spark, table, spec, "month").collect()
        assert got == reports.survey_distribution(full, spec, "month").collect()


def test_cells_equal_the_full_scan_after_refreshes(spark, folder):
    table = f"{folder}/table"
    source.refresh_table(spark, f"{folder}/csv", table)
    assert len(incremental.summarise(spark, table)) == 1
    compare(spark, table, SPECS[::2])
    (folder / "csv" / "1.csv").write_text(csv_text(rows_of(7, 30)))
    (folder / "csv" / "2.csv").unlink()
    source.refresh_table(spark, f"{folder}/csv", table)
    first = {p.name for p in (folder / "table" / "survey").glob("gen=*")}
    (gen,) = incremental.summarise(spark, table)
    assert f"gen={gen}" not in first and incremental.summarise(spark, table) == []
    compare(spark, table, SPECS[1::2])
    source.compact_table(spark, table)
    compare(spark, table, SPECS[:1])


def test_report_reads_cells_and_days_that_the_window_cuts(spark, folder):
    table = f"{folder}/table"
    source.refresh_table(spark, f"{folder}/csv", table)
    whole = incremental.survey_summary(spark, table, SPECS[0])
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert "size_sum" in plan and "vt_detection" not in plan and "scan_ts" not in plan
    cut = incremental.survey_summary(spark, table, SPECS[1])._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"scan_ts#\d+ < 2016-06-16 00:00:00", cut) and re.search(r"scan_ts#\d+ >= 2020-07-13 00:00:00", cut)


def test_bad_dates(spark, folder):
    (folder / "csv" / "bad.csv").write_text(csv_text([row(5, date="bad")]))
    table = f"{folder}/table"
    source.refresh_table(spark, f"{folder}/csv", table)
    with pytest.raises(classes.BadScanDateError, match="bad"):
        incremental.survey_summary(spark, table, SPECS[0])
    assert incremental.survey_summary(spark, table, SPECS[0], on_bad_date="drop").count() == 2
    (folder / "csv" / "bad.csv").unlink()
    source.refresh_table(spark, f"{folder}/csv", table)
    assert incremental.survey_size_estimate(spark, table, SPECS[0]).count() == 3


def test_no_table(spark, tmp_path):
    got = incremental.survey_summary(spark, f"{tmp_path}/none", SPECS[0])
    assert [(r["class"], r.available) for r in got.orderBy(F.desc("class")).collect()] == [("malware", 0), ("cleanware", 0)]
