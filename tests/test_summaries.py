import os
import time
from dataclasses import replace

import pytest

from sievecraft import CollectionSpec
from sievecraft.plans import collect, summaries
from sievecraft.sources import catalog as source
from tests.fixtures import csv_text, row

SPEC = CollectionSpec("2014-01-01 00:00:00", "2025-12-31 23:59:59", malware_threshold=1, n_malware=12, n_cleanware=30)


def rows_of(first, n, repeats=1):
    return [row(first + i // repeats, size=i, det="0" if i % 3 else "5") for i in range(n)]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "csv").mkdir()
    # keys that repeat within a generation and between two
    put(tmp_path, "a", rows_of(0, 3000) + rows_of(100, 200))
    put(tmp_path, "b", rows_of(5000, 2000, repeats=2))
    return tmp_path


def put(folder, name, rows, at=None):
    path = folder / "csv" / f"{name}.csv"
    path.write_text(csv_text(rows))
    if at:
        os.utime(path, (at, at))


def refresh(spark, folder):
    source.refresh_table(spark, f"{folder}/csv", f"{folder}/table")


def ids(sample):
    return sorted((r["class"], r.sample_rank, r.sha256, r.apk_size) for r in sample.collect())


def both(spark, folder, spec=SPEC):
    got = summaries.sample_from_summaries(spark, f"{folder}/table", f"{folder}/store", spec)
    want = collect.collect_sample(source.read_table(spark, f"{folder}/table"), spec)
    return got and ids(got), ids(want)


def test_samples_equal_the_draw_after_refreshes(spark, folder):
    refresh(spark, folder)
    got, want = both(spark, folder)
    assert got == want and len(want) == 42
    # copies of keys of the first generation, and a source that is replaced
    put(folder, "c", rows_of(0, 1500))
    put(folder, "b", rows_of(7000, 500), at=time.time() + 10)
    refresh(spark, folder)
    (gen,) = summaries.summarise(spark, f"{folder}/table", f"{folder}/store", SPEC)
    got, want = both(spark, folder)
    assert got == want
    smaller = replace(SPEC, n_malware=3, n_cleanware=1)
    assert summaries.summarise(spark, f"{folder}/table", f"{folder}/store", smaller) == []
    got, want = both(spark, folder, smaller)
    assert got == want
    plan = summaries.sample_from_summaries(spark, f"{folder}/table", f"{folder}/store", SPEC)._jdf.queryExecution().optimizedPlan()
    files = spark.read.parquet(f"{folder}/store/*/gen=*/rows").count()
    assert f"{folder}/table/data" not in plan.toString() and files < source.read_table(spark, f"{folder}/table").count()


def test_larger_requests_and_all_there_is(spark, folder):
    refresh(spark, folder)
    both(spark, folder)
    got, want = both(spark, folder, replace(SPEC, n_malware=100, n_cleanware=10_000))
    assert got == want and len(want) > 3000


def test_keys_with_many_copies_are_drawn_from_the_table(spark, folder):
    put(folder, "hot", [row(1, size=i) for i in range(summaries.COPIES + 1)])
    refresh(spark, folder)
    got, want = both(spark, folder)
    assert got is None
    assert ids(summaries.collect_sample(spark, f"{folder}/table", f"{folder}/store", SPEC)) == want


def test_many_generations_are_drawn_from_the_table(spark, tmp_path, monkeypatch):
    (tmp_path / "csv").mkdir()
    monkeypatch.setattr(summaries, "COPIES", 2)
    for n in range(3):
        put(tmp_path, f"s{n}", rows_of(0, 40))
        refresh(spark, tmp_path)
        got, want = both(spark, tmp_path)
        assert got == (want if n < 2 else None)
    # one generation again
    source.compact_table(spark, f"{tmp_path}/table")
    assert both(spark, tmp_path)[0] is None  # its keys have three rows each
