import os
import time

import pytest
from pyspark.sql import functions as F

from sievecraft import CollectionSpec
from sievecraft.operators import classes
from sievecraft.plans import reports
from sievecraft.sources import catalog as source
from sievecraft.sources import csv_files, manifest
from tests.fixtures import TEN, catalog, csv_text, row, tuples

ROWS = [row(i, *values) for i, values in enumerate(TEN, 1)]
SPEC = CollectionSpec("2014-01-01 00:00:00", "2025-12-31 23:59:59", malware_threshold=1)


def write(path, rows, at=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(csv_text(rows))
    if at is not None:
        os.utime(path, (at, at))


def counts(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture
def folder(tmp_path):
    write(tmp_path / "csv" / "a.csv", ROWS)
    return tmp_path


def refresh(spark, folder, **options):
    (done,) = counts(source.refresh_table(spark, f"{folder}/csv", f"{folder}/table", **options))
    return done


def test_csv(spark, folder):
    df = source.read_csv(spark, f"{folder}/csv/a.csv")
    first = {r.sha256: r for r in df.collect()}
    assert len(first) == 10
    missing = first[f"{2:064X}"]
    assert (missing.vt_detection, missing.vt_scan_date, missing.pkg_name) == (None, None, "com.example")


def test_csv_quotes(spark, tmp_path):
    write(tmp_path / "a.csv", [row(1, name='say ""hi"", you'), row(2, name=r"back\slash")])
    names = {r.pkg_name for r in source.read_csv(spark, f"{tmp_path}/a.csv").collect()}
    assert names == {'say "hi", you', r"back\slash"}


def test_broken_row_fails(spark, tmp_path):
    write(tmp_path / "a.csv", [row(1, size="much")])
    with pytest.raises(Exception, match="MALFORMED"):
        source.read_csv(spark, f"{tmp_path}/a.csv").collect()
    assert source.read_csv(spark, f"{tmp_path}/a.csv", "PERMISSIVE").head().apk_size is None


def test_convert_and_read(spark, folder):
    assert refresh(spark, folder) == (1, 10)
    table = source.read_table(spark, f"{folder}/table")
    want = reports.survey_summary(source.read_csv(spark, f"{folder}/csv"), SPEC).collect()
    assert reports.survey_summary(table, SPEC).collect() == want
    types = dict(table.dtypes)
    assert (types["det"], types["scan_ts"], types["scan_year"]) == ("bigint", "timestamp", "int")
    assert table.where("scan_year is null").count() == 1


def test_unchanged_is_left_alone(spark, folder):
    refresh(spark, folder)
    before = source.catalog_id(spark, f"{folder}/table")
    assert source.is_current(spark, f"{folder}/csv", f"{folder}/table")
    assert refresh(spark, folder) == (0, 0)
    assert source.catalog_id(spark, f"{folder}/table") == before
    assert refresh(spark, folder, force=True) == (1, 10)
    assert source.catalog_id(spark, f"{folder}/table") != before
    assert source.read_table(spark, f"{folder}/table").count() == 10


def test_only_changes_are_converted(spark, folder):
    write(folder / "csv" / "b.csv", [row(i) for i in range(100, 105)])
    assert refresh(spark, folder) == (2, 15)
    write(folder / "csv" / "b.csv", [row(i) for i in range(200, 203)], at=time.time() + 10)
    write(folder / "csv" / "c.csv", [row(300)])
    assert not source.is_current(spark, f"{folder}/csv", f"{folder}/table")
    assert refresh(spark, folder) == (2, 4)
    keys = {int(r.sha256, 16) for r in source.read_table(spark, f"{folder}/table").collect()}
    assert keys == set(range(1, 11)) | {200, 201, 202, 300}


@pytest.mark.parametrize("shift, current", [(0.0, True), (0.05, True), (0.3, False), (-0.3, False)])
def test_modification_time(spark, folder, shift, current):
    at = 1_700_000_000.0
    write(folder / "csv" / "a.csv", ROWS, at)
    refresh(spark, folder)
    write(folder / "csv" / "a.csv", ROWS, at + shift)
    assert source.is_current(spark, f"{folder}/csv", f"{folder}/table") == current


def test_size_counts_too(spark, folder):
    write(folder / "csv" / "a.csv", ROWS, 1_700_000_000)
    refresh(spark, folder)
    write(folder / "csv" / "a.csv", ROWS[:9], 1_700_000_000)
    assert not source.is_current(spark, f"{folder}/csv", f"{folder}/table")


def test_no_table_is_not_current(spark, folder):
    assert not source.is_current(spark, f"{folder}/csv", f"{folder}/table")
    assert source.read_table(spark, f"{folder}/table").isEmpty()


def test_a_file_that_is_gone_is_retired(spark, folder):
    write(folder / "csv" / "b.csv", [row(100)])
    refresh(spark, folder)
    (folder / "csv" / "b.csv").unlink()
    assert not source.is_current(spark, f"{folder}/csv", f"{folder}/table")
    assert refresh(spark, folder) == (0, 0)
    assert source.read_table(spark, f"{folder}/table").count() == 10


def test_empty_file(spark, folder):
    write(folder / "csv" / "a.csv", [])
    assert refresh(spark, folder) == (1, 0)
    assert source.read_table(spark, f"{folder}/table").count() == 0
    assert refresh(spark, folder) == (0, 0)


def test_half_done_refresh_is_not_seen(spark, folder):
    refresh(spark, folder)
    raw = source.read_csv(spark, f"{folder}/csv").withColumn("source_path", F.lit("x"))
    source.write_generation(raw, f"{folder}/table", "dead", 1)
    assert source.read_table(spark, f"{folder}/table").count() == 10


def test_manifest(spark, folder):
    refresh(spark, folder, fingerprint=True)
    (record,) = source.live_sources(spark, f"{folder}/table").collect()
    path = folder / "csv" / "a.csv"
    assert record.source_path.endswith("/csv/a.csv")
    assert (record.size, record.n_rows) == (path.stat().st_size, 10)
    assert abs(record.mtime.timestamp() - path.stat().st_mtime) < 0.1 or record.mtime.tzinfo is None
    first = record.content_hash
    write(path, list(reversed(ROWS)), at=time.time() + 10)
    refresh(spark, folder, fingerprint=True)
    assert source.live_sources(spark, f"{folder}/table").head().content_hash == first
    write(path, ROWS[:9], at=time.time() + 20)
    refresh(spark, folder, fingerprint=True)
    assert source.live_sources(spark, f"{folder}/table").head().content_hash != first


def test_other_time_zone_is_refused(spark, folder):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        with pytest.raises(ValueError):
            refresh(spark, folder)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_open_by_suffix(spark, folder):
    assert source.open_catalog(spark, f"{folder}/csv/a.csv").count() == 10
    assert (folder / "csv" / "a.table").exists()
    source.read_csv(spark, f"{folder}/csv/a.csv").write.parquet(f"{folder}/x.parquet")
    assert "det" in source.open_catalog(spark, f"{folder}/x.parquet").columns
    source.read_csv(spark, f"{folder}/csv/a.csv").write.parquet(f"{folder}/x.data")
    with pytest.warns(UserWarning):
        assert source.open_catalog(spark, f"{folder}/x.data").count() == 10


def test_bad_dates_are_found_in_the_table(spark, folder):
    write(folder / "csv" / "b.csv", [row(100, date="bad")])
    refresh(spark, folder)
    with pytest.raises(classes.BadScanDateError):
        reports.survey_summary(source.read_table(spark, f"{folder}/table"), SPEC)


def test_pushdown_and_pruning(spark, folder):
    refresh(spark, folder)
    table = source.read_table(spark, f"{folder}/table")
    spec = CollectionSpec("2016-01-01 00:00:00", "2017-06-01 00:00:00")
    report = reports.survey_distribution(table, spec, "year", on_bad_date="drop")
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(scan_ts" in plan and "LessThanOrEqual(scan_ts" in plan
    assert "scan_year" in plan.split("PartitionFilters: [")[1].split("]")[0]
    read = plan.split("ReadSchema: ")[1]
    assert "pkg_name" not in read and "md5" not in read
    assert [r[0] for r in tuples(report, "period")] == [2016]


def test_pushdown_on_raw_text(spark, folder):
    df = source.read_csv(spark, f"{folder}/csv")
    plan = classes.base(df, SPEC)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(vt_scan_date" in plan


def test_failed_refresh_takes_nothing_away(spark, folder):
    """The only source is replaced by one under another name that does not convert."""
    refresh(spark, folder)
    (folder / "csv" / "a.csv").rename(folder / "csv" / "b.csv")
    (folder / "csv" / "b.csv").write_text(csv_text([row(1, size="no number")]))
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        refresh(spark, folder)
    assert source.read_table(spark, f"{folder}/table").count() == 10


def test_many_small_sources_make_few_files(spark, folder):
    """Files follow years and bytes, not sources."""
    for i in range(40):
        write(folder / "csv" / f"s{i:03d}.csv", [row(100 * i + k, date=f"{2010 + k % 5}-01-02 03:04:05") for k in range(10)])
    refresh(spark, folder)
    table = f"{folder}/table"
    held = source.read_table(spark, table).count()
    files = list((folder / "table" / "data").glob("gen=*/scan_year=*/*.parquet"))
    years = {f.parent.name for f in files}
    assert len(files) <= len(years) + 8
    # two sources go, one changes; compaction then leaves the same rows in one generation
    for name in ("s000.csv", "s001.csv"):
        (folder / "csv" / name).unlink()
    write(folder / "csv" / "s002.csv", [row(9000 + k) for k in range(3)])
    refresh(spark, folder)
    assert source.read_table(spark, table).count() == held - 30 + 3
    before = sorted(r.sha256 for r in source.read_table(spark, table).collect())
    gen = source.compact_table(spark, table)
    after = source.read_table(spark, table)
    assert sorted(r.sha256 for r in after.collect()) == before and {r.gen for r in after.select("gen").distinct().collect()} == {gen}
    assert refresh(spark, folder) == (0, 0)


FIELDS = source.RAW_SCHEMA.fieldNames()


def csv_by_header(names, rows, end="\n"):
    """Rows (dicts) under these column names; every field quoted."""
    lines = [",".join(names)]
    lines += [",".join('"' + str(r.get(n, "extra")).replace('"', '""') + '"' for n in names) for r in rows]
    return end.join(lines) + end


def record(key, **more):
    return dict(zip(FIELDS, row(key))) | more


def test_columns_follow_the_header(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    swapped = [*FIELDS[:5], FIELDS[7], FIELDS[6], FIELDS[5], *FIELDS[8:]]
    files = {
        "fixed": csv_by_header(FIELDS, [record(1)]),
        "swapped": csv_by_header(swapped, [record(2, vt_detection=5, pkg_name="pkg")]),
        "extra": csv_by_header(["new", *FIELDS, "other"], [record(3)]),
        "absent": csv_by_header([f for f in FIELDS if f not in ("dex_date", "apk_size")], [record(4)]),
        "broken": csv_by_header(FIELDS, [record(5, pkg_name='two\nlines, "quoted"'), record(6)]),
        "crlf": "\ufeff" + csv_by_header(FIELDS, [record(7)], "\r\n"),
        "a b%20[c]": csv_by_header(reversed_fields := FIELDS[::-1], [record(8)]),
        "blank first": "\n\n" + csv_by_header(FIELDS, [record(9)]),
        "empty": "",
        "header only": csv_by_header(FIELDS, []),
    }
    assert reversed_fields != FIELDS
    for name, text in files.items():
        (tmp_path / "csv" / f"{name}.csv").write_text(text, newline="")
    assert refresh(spark, tmp_path) == (9, 9)  # a file without a byte is not listed
    rows = {int(r.sha256, 16): r for r in source.read_table(spark, f"{tmp_path}/table").collect()}
    assert sorted(rows) == list(range(1, 10))
    assert (rows[2].pkg_name, rows[2].vt_detection, rows[2].det) == ("pkg", "5", 5)
    assert (rows[4].apk_size, rows[4].dex_date, rows[4].markets) == (None, None, "play.google.com")
    assert rows[5].pkg_name == 'two\nlines, "quoted"' and rows[5].markets == rows[6].markets == "play.google.com"
    for key in (1, 3, 6, 7, 8, 9):
        assert {f: rows[key][f] for f in FIELDS} == record(key)
    assert refresh(spark, tmp_path) == (0, 0)
    assert source.read_csv(spark, f"{tmp_path}/csv").count() == 9


@pytest.mark.parametrize("names", [FIELDS[1:], [*FIELDS, "markets"]])
def test_headers_that_are_refused(spark, tmp_path, names):
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "odd.csv").write_text(csv_by_header(names, [record(1)]))
    with pytest.raises(csv_files.HeaderError, match="odd.csv"):
        refresh(spark, tmp_path)


def keys(spark, folder):
    return sorted(int(r.sha256, 16) for r in source.read_table(spark, f"{folder}/table").collect())


def between(monkeypatch, what):
    """Has ``what`` run once, after the next generation is written and before it is published."""
    real, left = source.write_generation, [what]

    def write_and(*args):
        real(*args)
        if left:
            left.pop()()

    monkeypatch.setattr(source, "write_generation", write_and)


def test_refresh_during_a_compaction_stays(spark, folder, monkeypatch):
    write(folder / "csv" / "b.csv", [row(100), row(101)])
    write(folder / "csv" / "c.csv", [row(102)])
    refresh(spark, folder)

    def other():
        write(folder / "csv" / "b.csv", [row(200)], at=time.time() + 10)
        (folder / "csv" / "c.csv").unlink()
        assert refresh(spark, folder) == (1, 1)

    between(monkeypatch, other)
    gen = source.compact_table(spark, f"{folder}/table")
    assert keys(spark, folder) == [*range(1, 11), 200]
    # what nobody touched is compacted
    assert {r.gen for r in source.live_sources(spark, f"{folder}/table").collect()} > {gen}
    assert refresh(spark, folder) == (0, 0)


def test_of_two_refreshes_the_later_state_wins(spark, folder, monkeypatch):
    now = time.time()
    write(folder / "csv" / "b.csv", [row(100)], at=now + 10)

    def other():
        write(folder / "csv" / "b.csv", [row(200), row(201)], at=now + 20)
        refresh(spark, folder)

    between(monkeypatch, other)
    assert refresh(spark, folder) == (0, 0)
    assert keys(spark, folder) == [*range(1, 11), 200, 201]
    assert source.is_current(spark, f"{folder}/csv", f"{folder}/table")

    # the same file converted twice at a time is in the table once
    write(folder / "csv" / "d.csv", [row(300)])
    between(monkeypatch, lambda: refresh(spark, folder))
    refresh(spark, folder)
    assert keys(spark, folder) == [*range(1, 11), 200, 201, 300]


def test_a_version_is_published_once(spark, folder):
    refresh(spark, folder)
    before = manifest.snapshot(spark, f"{folder}/table")
    assert before.version == 1
    records = source.retired(before.live)
    assert manifest.publish(spark, f"{folder}/table", records, before) == 2
    # the second writer finds the source gone, and has nothing left to say
    assert manifest.publish(spark, f"{folder}/table", records, before) == 3
    assert keys(spark, folder) == []
    assert source.read_manifest(spark, f"{folder}/table", 1).count() == 1


def test_fingerprint_tells_pairs_of_equal_rows_apart(spark, folder):
    at = 1_700_000_000.0
    write(folder / "csv" / "a.csv", [row(1), row(1), row(3)], at)
    assert refresh(spark, folder, check_content=True) == (1, 3)
    assert refresh(spark, folder, check_content=True) == (0, 0)
    write(folder / "csv" / "a.csv", [row(2), row(2), row(3)], at)
    assert refresh(spark, folder) == (0, 0)  # size and time are as recorded
    assert refresh(spark, folder, check_content=True) == (1, 3)
    assert keys(spark, folder) == [2, 2, 3]


def test_table_that_is_made_anew(spark, folder):
    """Another table under the name and version of one that was read."""
    refresh(spark, folder)
    assert keys(spark, folder) == list(range(1, 11))
    (folder / "table").rename(folder / "old")
    write(folder / "csv" / "a.csv", [row(77)])
    refresh(spark, folder)
    assert manifest.latest_version(spark, f"{folder}/table") == 1 and keys(spark, folder) == [77]


def test_no_scan_of_lines_or_rows_sorts_them(spark, tmp_path):
    """Headers of files and counts of sources come from maps of a few keys, whatever the files hold."""
    (tmp_path / "a.csv").write_text(csv_text([row(1), row(2, name='two\nlines')]))
    url = f"file:{tmp_path}/a.csv"
    found = csv_files.headers(spark, [url])
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r.header.split(",")[0], r.breaks) for r in found.collect()] == [("sha256", True)]
    raw = catalog(spark, [row(1), row(2)]).withColumn("source_path", F.lit(url))
    source.write_generation(raw, f"{tmp_path}/table", "one", 1)
    sources = spark.createDataFrame([(url, 1, None)], "source_path string, size long, mtime timestamp")
    records = source.records_of(sources, f"{tmp_path}/table", "one")
    assert "SortAggregate" not in records._jdf.queryExecution().executedPlan().toString()
    assert [(r.n_rows, r.content_hash) for r in records.collect()] == [(2, None)]


def test_rows_travel_narrow_and_come_back_as_they_were(spark, tmp_path):
    hashes = ["AB" * 32, "ab" * 32, "aB" * 32, "abc", "", "xyz", "é", None]
    dates = ["2023-01-01 00:00:00", "2023-1-1 0:0:0", "0000-01-01 00:00:00", "bad", "", None, "9999-12-31 23:59:59", "2023-02-30 00:00:00"]
    rows = [(h, g, *row(1, date=d)[2:]) for h, g, d in zip(hashes, hashes[1:] + hashes[:1], dates, strict=True)]
    raw = catalog(spark, rows).withColumn("source_path", F.lit("file:/x.csv"))
    source.write_generation(raw, f"{tmp_path}/table", "one", 1)
    held = spark.read.schema(source.TABLE_SCHEMA).option("basePath", f"{tmp_path}/table/data").parquet(f"{tmp_path}/table/data/gen=one")
    got = held.select(*source.CATALOG_FIELDS, "det", "scan_ts", "source_id", "scan_year")
    want = classes.with_typed_columns(raw).withColumns({"source_id": source.source_id(), "scan_year": F.year("scan_ts")})
    assert got.exceptAll(want.select(got.columns)).isEmpty() and got.count() == len(rows)
    # what is shuffled, and sorted in memory, holds hex digits as bytes
    packed = raw.select(source._packed("sha256"))
    assert [len(r[0]) for r in packed.limit(2).collect()] == [32, 32]
    assert source.text_size("file:/x.csv.gz", 10) == 30 and source.text_size("file:/x.csv", 10) == 10


def test_rows_of_odd_detections_and_dates_come_back_and_travel_in_few_columns(spark, tmp_path, monkeypatch):
    dates = ["0000-01-01 00:00:00", "1969-12-31 23:59:59", "1970-01-01 00:00:00", "9999-12-31 23:59:59", "2023-02-30 00:00:00", None]
    detections = ["7", "07", " 7", "+7", "-7", "x", "", None, "9223372036854775807", "9223372036854775808", "1.0"]
    rows = [row(i, det=d, date=t) for i, (d, t) in enumerate([(d, t) for d in detections for t in dates], 1)]
    raw = catalog(spark, rows).withColumn("source_path", F.lit("file:/x.csv"))
    kind, shuffled = type(raw), []
    real = kind.repartitionByRange
    monkeypatch.setattr(kind, "repartitionByRange", lambda self, n, *by: shuffled.append((n, self)) or real(self, n, *by))
    # of 245 shares: a task that reads would hold all its rows for more than 200 parts
    source.write_generation(raw, f"{tmp_path}/table", "one", 245 * source.TARGET_BYTES)
    held = spark.read.schema(source.TABLE_SCHEMA).option("basePath", f"{tmp_path}/table/data").parquet(f"{tmp_path}/table/data/gen=one")
    got = held.select(*source.CATALOG_FIELDS, "det", "scan_ts", "source_id", "scan_year")
    want = classes.with_typed_columns(raw).withColumns({"source_id": source.source_id(), "scan_year": F.year("scan_ts")})
    assert got.exceptAll(want.select(got.columns)).isEmpty() and got.count() == len(rows)
    ((n, travels),) = shuffled
    assert n == 200 and "scan_year" not in travels.columns
    kept = {r[0] for r in travels.select("vt_detection").collect()}
    assert kept == {None, "07", " 7", "+7", "x", "", "9223372036854775808", "1.0"}
    # rows of one time, or of none, have places of their own
    assert travels.select("_place").distinct().count() == len(rows)
    assert travels.where(F.col("_place") < source._NEVER // 2).count() == 2 * len(detections)


def test_tasks_that_write_a_table(spark):
    share = source.TARGET_BYTES
    assert [source.write_tasks(spark, n * share) for n in (100, 200, 201, 400, 401, 1000)] == [100, 200, 200, 200, 401, 1000]
