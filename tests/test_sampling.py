import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievecraft import CollectionSpec
from sievecraft.operators import copies, sampling
from sievecraft.plans import collect
from tests.fixtures import catalog, row

SPEC = CollectionSpec(n_malware=40, n_cleanware=60)


def many(spark, n=1000):
    return catalog(spark, [row(i, size=i, det="9" if i % 3 == 0 else "0") for i in range(n)])


def ranked(sample):
    return {
        c: [r.sha256 for r in sorted(rows, key=lambda r: r.sample_rank)]
        for c in ("malware", "cleanware")
        for rows in [[r for r in sample.collect() if r["class"] == c]]
    }


def test_exact_size_subset_no_repeats(spark):
    sample = collect.collect_sample(many(spark), SPEC)
    got = ranked(sample)
    assert {c: len(v) for c, v in got.items()} == SPEC.wanted
    assert all(len(set(v)) == len(v) for v in got.values())
    assert all(int(k, 16) % 3 == 0 for k in got["malware"])
    assert all(int(k, 16) % 3 for k in got["cleanware"])
    ranks = sorted(r.sample_rank for r in sample.where("class = 'malware'").collect())
    assert ranks == list(range(1, 41))
    assert sample.columns[:3] == ["class", "sample_rank", "sha256"]


def test_order_is_the_hash_order(spark):
    keys = [f"{i:064X}" for i in range(1000) if i % 3 == 0]
    want = sorted(keys, key=lambda k: hashlib.sha256(f"42:{k}".encode()).hexdigest())[:40]
    assert ranked(collect.collect_sample(many(spark), SPEC))["malware"] == want


def test_same_whatever_the_partitions(spark):
    df = many(spark)
    want = ranked(collect.collect_sample(df, SPEC))
    assert ranked(collect.collect_sample(df.repartition(7), SPEC)) == want
    assert ranked(collect.collect_sample(df.coalesce(1).orderBy(F.desc("sha256")), SPEC)) == want
    assert ranked(collect.collect_sample(df, SPEC, keys_unique=True)) == want


def test_smaller_sample_is_a_prefix(spark):
    df = many(spark)
    big = collect.collect_sample(df, CollectionSpec(n_malware=200, n_cleanware=300))
    small = CollectionSpec(n_malware=11, n_cleanware=13)
    want = ranked(collect.collect_sample(df, small))
    assert ranked(sampling.trim(big, small.wanted)) == want
    assert all(ranked(big)[c][: len(v)] == v for c, v in want.items())


def test_seeds_differ(spark):
    df = many(spark)
    a, b = (ranked(collect.collect_sample(df, CollectionSpec(random_seed=s, n_malware=40))) for s in (1, 2))
    assert a["malware"] != b["malware"]
    free = CollectionSpec(random_seed=None, n_malware=40)
    assert ranked(collect.collect_sample(df, free)) != ranked(collect.collect_sample(df, free))


def test_takes_all_when_there_are_no_more(spark):
    got = ranked(collect.collect_sample(many(spark, 30), CollectionSpec(n_malware=10, n_cleanware=1000)))
    assert (len(got["malware"]), len(got["cleanware"])) == (10, 20)


def test_empty_class(spark):
    df = catalog(spark, [row(i) for i in range(5)])
    assert {c: len(v) for c, v in ranked(collect.collect_sample(df, SPEC)).items()} == {"malware": 0, "cleanware": 5}
    assert collect.collect_sample(df.limit(0), SPEC).isEmpty()


def test_uniform(spark):
    """Over many seeds every row is drawn about equally often."""
    df = catalog(spark, [row(i, det="9") for i in range(50)])
    rows = collect.candidates(df, SPEC).cache()
    hits = Counter()
    for seed in range(30):
        hits.update(r.sha256 for r in sampling.draw(rows, {"malware": 10}, seed, keys_unique=True).collect())
    rows.unpersist()
    # 30 draws with p = 0.2: chi-square over 50 rows, 0.999 quantile for 49 degrees of freedom is 85
    chi2 = sum((hits[f"{i:064X}"] - 6) ** 2 / (30 * 0.2 * 0.8) for i in range(50))
    assert chi2 < 85


def crowded(spark, hot=400):
    """1200 rows: a third are one row over and over, a third share a key, the rest are on their own."""
    rows = [row(1, size=7, det="9")] * hot
    rows += [row(2, size=i, det="9") for i in range(hot)]
    rows += [row(100 + i, det="9") for i in range(hot)]
    return catalog(spark, rows).repartition(5)


def brute_force(rows, n, seed=42):
    """Number copies by content, score, sort: in one list."""
    by_key = {}
    for r in rows:
        by_key.setdefault(r[0], []).append(r)
    scored = []
    for key, group in by_key.items():
        text = lambda r: "|".join("~" if v is None else str(v) for v in r)
        for i, r in enumerate(sorted(group, key=lambda r: (hashlib.sha256(text(r).encode()).hexdigest(), r))):
            place = f"{seed}:{key}" + (f":{i}" if i else "")
            scored.append((hashlib.sha256(place.encode()).hexdigest(), r))
    return [r for _, r in sorted(scored)[:n]]


@pytest.mark.parametrize("limit, length", [("10m", 100_000), ("-1", 7)])
def test_copies_against_brute_force(spark, monkeypatch, request, limit, length):
    """With repeated keys broadcast and piles laid out whole; with keys joined by a shuffle and piles in slices."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    request.addfinalizer(lambda: spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    monkeypatch.setattr(copies, "SLICE", length)
    df = crowded(spark)
    want = brute_force([tuple(r) for r in df.collect()], 300)
    sample = collect.collect_sample(df, CollectionSpec(n_malware=300))
    got = [tuple(r)[2:13] for r in sorted(sample.collect(), key=lambda r: r.sample_rank)]
    assert got == want
    # a fair share of each kind
    shares = Counter(min(int(r[0], 16), 3) for r in got)
    assert all(70 < n < 130 for n in shares.values()) and len(shares) == 3


def test_all_copies_come_back_when_all_are_taken(spark):
    df = crowded(spark)
    got = collect.collect_sample(df, CollectionSpec(n_malware=5000))
    assert Counter(r.sha256 for r in got.collect()) == Counter(r.sha256 for r in df.collect())


def test_copy_numbers(spark):
    once, repeated = copies.split(crowded(spark, 50), "sha256")
    assert once.count() == 50
    columns = repeated.columns
    for numbered in (copies.number(repeated, "sha256", columns), copies.places(repeated, ["sha256"])):
        got = {}
        for r in numbered.collect():
            got.setdefault(r.sha256, []).append(r["_copy"])
        assert {k: sorted(v) for k, v in got.items()} == {f"{k:064X}": list(range(50)) for k in (1, 2)}


def test_no_repeated_keys(spark):
    once, repeated = copies.split(many(spark, 20), "sha256")
    assert repeated is None and once.count() == 20


def test_rows_without_a_key(spark):
    df = catalog(spark, [row(None, size=i, det="9") for i in range(20)] + [row(i, det="9") for i in range(20)])
    got = collect.collect_sample(df, CollectionSpec(n_malware=30)).collect()
    assert len(got) == 30
    nulls = [r.apk_size for r in got if r.sha256 is None]
    assert len(set(nulls)) == len(nulls) > 5


def test_null_and_empty_keys_are_one_key(spark):
    rows = [row(None, size=i, det="9") for i in range(20)] + [row("", size=i, det="9") for i in range(20)]
    got = collect.collect_sample(catalog(spark, rows), CollectionSpec(n_malware=25))
    assert sorted(r.sample_rank for r in got.collect()) == list(range(1, 26))


def test_many_buckets(spark):
    """Ranks run on through the buckets of the score."""
    df = spark.range(20000).select(F.lit("malware").alias("class"), F.sha2(F.col("id").cast("string"), 256).alias("sha256"))
    sample = sampling.draw(df, {"malware": 15000}, 5)
    got = [r.sha256 for r in sample.orderBy("sample_rank").collect()]
    keys = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(20000)]
    assert got == sorted(keys, key=lambda k: hashlib.sha256(f"5:{k}".encode()).hexdigest())[:15000]
