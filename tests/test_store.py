from dataclasses import replace

import pytest

from sievecraft import CollectionSpec
from sievecraft.plans import collect
from sievecraft.sources import catalog as source
from sievecraft.sources import sample_store as store
from tests.fixtures import catalog, csv_text, row

SPEC = CollectionSpec(n_malware=20, n_cleanware=30)
KEY = SPEC.fingerprint("c", "collect")


@pytest.fixture
def sample(spark):
    df = catalog(spark, [row(i, det="9" if i % 2 else "0") for i in range(90)])
    return collect.collect_sample(df, SPEC)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_round_trip(spark, sample, tmp_path):
    store.write_sample(sample, str(tmp_path), KEY, SPEC.wanted)
    back = store.read_sample(spark, str(tmp_path), KEY, SPEC.wanted)
    assert rows(back.select(sample.columns)) == rows(sample)
    lines = next((tmp_path / KEY).glob("draw=*/class=malware/*.json")).read_text()
    assert '"scan_ts":"2023-01-01T00:00:00.000Z"' in lines


def test_smaller_request_is_trimmed(spark, sample, tmp_path):
    store.write_sample(sample, str(tmp_path), KEY, SPEC.wanted)
    back = store.read_sample(spark, str(tmp_path), KEY, {"malware": 3, "cleanware": 30})
    assert rows(back.select(sample.columns)) == rows(sample.where("class = 'cleanware' or sample_rank <= 3"))


def test_larger_request_misses(spark, sample, tmp_path):
    store.write_sample(sample, str(tmp_path), KEY, SPEC.wanted)
    assert store.read_sample(spark, str(tmp_path), KEY, {"malware": 21, "cleanware": 30}) is None


def test_any_request_is_served_once_all_is_stored(spark, tmp_path):
    all_rows = collect.collect_sample(catalog(spark, [row(i, det="9") for i in range(5)]), SPEC)
    store.write_sample(all_rows, str(tmp_path), KEY, SPEC.wanted)
    back = store.read_sample(spark, str(tmp_path), KEY, {"malware": 1000, "cleanware": 1000})
    assert back.count() == 5


def test_nothing_stored(spark, sample, tmp_path):
    assert store.read_sample(spark, str(tmp_path), KEY, SPEC.wanted) is None
    store.write_sample(sample, str(tmp_path), KEY, SPEC.wanted)
    assert store.read_sample(spark, str(tmp_path), "other", SPEC.wanted) is None


@pytest.mark.parametrize("damage", ["cut", "lost"])
def test_damaged_is_a_miss(spark, sample, tmp_path, damage):
    store.write_sample(sample, str(tmp_path), KEY, SPEC.wanted)
    file = next((tmp_path / KEY).glob("draw=*/class=malware/*.json"))
    if damage == "cut":
        file.write_text(file.read_text()[:-40])
    else:
        file.unlink()
    for crc in file.parent.glob(".*.crc"):
        crc.unlink()
    assert store.read_sample(spark, str(tmp_path), KEY, SPEC.wanted) is None


def test_empty_sample(spark, sample, tmp_path):
    store.write_sample(sample.limit(0), str(tmp_path), KEY, SPEC.wanted)
    back = store.read_sample(spark, str(tmp_path), KEY, SPEC.wanted)
    assert back is not None and back.isEmpty()


def test_stored_sample_of_a_table(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    file = tmp_path / "csv" / "a.csv"
    file.write_text(csv_text([row(i, det="9" if i % 2 else "0") for i in range(90)]))
    table, kept = f"{tmp_path}/table", f"{tmp_path}/store"
    source.refresh_table(spark, f"{tmp_path}/csv", table)
    get = lambda spec, **o: collect.stored_sample(spark, table, kept, spec, **o)
    draws = lambda: len(list((tmp_path / "store").glob("*/draw=*")))
    first = rows(get(SPEC))
    assert draws() == 1 and len(first) == 50
    assert rows(get(SPEC)) == first and draws() == 1
    get(replace(SPEC, n_malware=5))
    assert draws() == 1
    get(replace(SPEC, n_malware=25))
    assert draws() == 2
    assert rows(get(SPEC, force=True)) == first and draws() == 3
    get(replace(SPEC, random_seed=7))
    assert draws() == 4
    # a changed catalogue is another key
    file.write_text(csv_text([row(i, det="9" if i % 2 else "0") for i in range(95)]))
    source.refresh_table(spark, f"{tmp_path}/csv", table)
    get(SPEC)
    assert draws() == 5
    # an unseeded sample is kept too, under the seed that was drawn for it
    assert get(replace(SPEC, random_seed=None)).count() == 50 and draws() == 6
    seeds = [r.seed for r in store.drawn_seeds(spark, kept).collect()]
    assert len(seeds) == 6 and None not in seeds
    # neither a bad date's rule nor a claim of unique keys may share a stored sample
    get(SPEC, on_bad_date="drop")
    get(SPEC, keys_unique=True)
    assert draws() == 8


def read_lines(folder):
    return "".join(p.read_text() for p in sorted(folder.glob("part-*"))).splitlines()


@pytest.mark.parametrize("one_file", [False, True])
def test_export(spark, sample, tmp_path, one_file):
    written = store.export_hashes(sample, str(tmp_path), one_file=one_file)
    assert [w.rsplit("/", 1)[1] for w in written] == ["malware.txt", "cleanware.txt"]
    for cls in ("malware", "cleanware"):
        want = [r.sha256 for r in sample.where(f"class = '{cls}'").orderBy("sample_rank").collect()]
        assert read_lines(tmp_path / f"{cls}.txt") == want
        assert not one_file or len(list((tmp_path / f"{cls}.txt").glob("part-*"))) == 1


def test_export_of_an_empty_class(spark, sample, tmp_path):
    only = sample.where("class = 'malware'")
    assert len(store.export_hashes(only, f"{tmp_path}/a")) == 1
    assert not (tmp_path / "a" / "cleanware.txt").exists()
    assert len(store.export_hashes(only, f"{tmp_path}/b", write_empty=True)) == 2
    assert read_lines(tmp_path / "b" / "cleanware.txt") == []
