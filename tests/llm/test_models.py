"""What the models are made of, and results that must not depend on where work is cut."""

import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sievecraft.llm import chat, decontamination, neardup, neighbours, quality, sharding, toxicity
from tests.llm.test_operators import brute_groups


@pytest.mark.parametrize("lengths", [[200], [64], [65, 0, 1, 128, 300, 64, 2], [0, 0, 5]])
def test_texts_are_scored_as_one_chain(lengths):
    rng = np.random.default_rng(len(lengths))
    lengths = np.array(lengths)
    move, first = 2 * rng.normal(size=(2, 2)), rng.normal(size=2)
    values = 3 * rng.normal(size=lengths.sum())
    row, column, opens = toxicity.chains(lengths)
    emission, valid = np.zeros((len(opens), toxicity.CHAIN)), np.zeros((len(opens), toxicity.CHAIN), bool)
    emission[row, column], valid[row, column] = values, True
    toxic, pairs, total = toxicity.marginals(emission, valid, move, first, opens)
    got = np.split(toxic[row, column], np.cumsum(lengths)[:-1])
    want_pairs, want_total = np.zeros((2, 2)), 0.0
    for own, text in zip(got, np.split(values, np.cumsum(lengths)[:-1])):
        if len(text):
            one, own_pairs, own_total = toxicity.marginals(text[None], np.ones((1, len(text)), bool), move, first)
            assert np.allclose(own, one[0])
            want_pairs, want_total = want_pairs + own_pairs, want_total + own_total
    assert np.allclose(pairs, want_pairs) and np.isclose(total, want_total)


def test_prior_of_a_known_share(spark):
    """Good texts are three in ten of the unlabelled; only the first of 20,000 rows take part in the fit."""
    rng = np.random.default_rng(7)
    good = rng.random(6000) < 0.3
    texts = [("word " * 30 + "fine. ") if g else "@@ ## 12 " * int(rng.integers(5, 20)) for g in good]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in np.flatnonzero(good)[:400].tolist()], "doc_id long, quality int")
    scorer = quality.fit(docs, labels, 300, 500)
    assert abs(scorer.prior - 0.3) < 0.05
    train = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5]
    cuts = np.array([-1e9, 0.0, 1e9])
    above, n = quality.count_above(docs.where(F.col("doc_id").isin(train[:500])), scorer, cuts)
    x = np.stack([quality.statistics(texts[i]) for i in train[:500]]).astype(float)
    assert n == 500 and above.tolist() == [500, int((scorer.margin(x) >= 0).sum()), 0]


def test_weights_have_the_least_non_negative_risk():
    """The minimiser against a plain search over one weight and a bias."""
    rng = np.random.default_rng(3)
    p, u = rng.normal(1.0, 1, (400, 1)), np.concatenate([rng.normal(1.0, 1, (300, 1)), rng.normal(-1.5, 1, (700, 1))])

    def risk(w, b, prior=0.3):
        soft = lambda z: np.logaddexp(0, z)
        plus, minus = soft(-(p @ w + b)).mean(), soft(p @ w + b).mean()
        return prior * plus + max(0.0, soft(u @ w + b).mean() - prior * minus)

    w, b = quality.minimise(p, u, 0.3, rounds=1500)
    grid = [(risk(np.array([x]), y), x, y) for x in np.linspace(-1, 4, 51) for y in np.linspace(-3, 3, 61)]
    assert risk(w, b) <= min(grid)[0] + 0.01


def test_shards_are_the_highest_scores(spark):
    """Every row's shard is the arg-max of recomputed scores, and one more shard takes about its share of rows."""
    df = spark.range(3000).withColumn("weights", F.lit(0))
    weights = [1.0, 2.0, 0.0, 1.0]
    rows = sharding.with_shards(df, "id", weights, grown_weight=1.0)
    unit = [(F.shiftrightunsigned(F.xxhash64(F.lit(s), F.col("id").cast("string")), 11) + 0.5) / float(1 << 53) for s in range(5)]
    scored = rows.select("shard", "grown_shard", *[u.alias(f"u{i}") for i, u in enumerate(unit)]).collect()
    moved = 0
    for r in scored:
        scores = [-w / np.log(r[f"u{i}"]) if w else -1 for i, w in enumerate([*weights, 1.0])]
        assert r.shard == int(np.argmax(scores[:4])) and r.grown_shard == int(np.argmax(scores))
        moved += r.grown_shard != r.shard
    assert abs(moved / 3000 - 1 / 5) < 0.04
    counts = np.bincount([r.shard for r in scored], minlength=4) / 3000
    assert np.allclose(counts, [0.25, 0.5, 0, 0.25], atol=0.04)


def test_op7_equals_its_sql_beyond_a_range(spark, tmp_path):
    rows = [("long", i, ["ann", "bob", "cy", "system"][i * 7 % 4], f"t{i}") for i in range(1100)]
    rows += [("seventy", i, ["ann", "bob"][i % 2], None if i == 3 else f"é{i}") for i in range(70)]
    rows += [("seventy", None, " ", "no turn"), ("alone", 0, "system", "x"), (None, 1, "ann", "y"), ("long", 5, "ann", "again"), ("long", 5, "ann", "again")]
    spark.createDataFrame(rows, "conv_id string, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = chat.op7_perspective_rotation(spark, str(tmp_path))
    names = sorted(got.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(chat.OP7_SQL)
    at = {c[0]: i for i, c in enumerate(want.description)}
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=key) == sorted(
        (tuple(r[at[n]] for n in names) for r in want.fetchall()), key=key
    )
    assert {r.block for r in got.where("conv_id = 'long'").collect()} == {0, 1, 2}


def test_many_indexes_find_what_one_finds(spark, monkeypatch):
    rng = np.random.default_rng(9)
    item = lambda: " ".join(f"q{x}" for x in rng.integers(0, 4000, 25)) + ". " + " ".join(f"a{x}" for x in rng.integers(0, 4000, 8))
    items = [item() for _ in range(23)]
    texts = [" ".join(f"t{x}" for x in rng.integers(0, 4000, 60)) for _ in range(60)]
    texts = [t + " " + items[i // 2] + " " + t if i % 2 else t for i, t in enumerate(texts[:46])] + texts[46:]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    whole = decontamination.contamination(docs, benchmark).select("doc_id", "item_id", "overlap").collect()
    assert {(r.doc_id, r.item_id) for r in whole} == {(2 * n + 1, n) for n in range(23)}
    real = decontamination.indexes
    for limits in ({"items": 5}, {"letters": 600}):
        monkeypatch.setattr(decontamination, "indexes", lambda b, how=limits: real(b, **how))
        assert len(list(decontamination.indexes(benchmark))) > 3
        assert sorted(decontamination.contamination(docs, benchmark).select("doc_id", "item_id", "overlap").collect()) == sorted(whole)
        kept = decontamination.decontaminated(docs, benchmark)
        assert {r.doc_id for r in kept.collect()} == set(range(60)) - {2 * n + 1 for n in range(23)}


@pytest.mark.parametrize(("candidates", "queries", "c_group", "q_group"), [(7, 3, 2, 2), (50, 2, 1, 5)])
def test_neighbours_do_not_depend_on_blocks_and_groups(spark, monkeypatch, candidates, queries, c_group, q_group):
    for name, value in zip(("CANDIDATES", "QUERIES", "C_GROUP", "Q_GROUP"), (candidates, queries, c_group, q_group)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(300, 12)).round(1)
    vectors[10:40] = vectors[0]
    vectors[50] *= 1e200
    vectors[51] *= 1e-160
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(1000 + i, [float(i), 1.0]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = {}
    for r in neighbours.nearest(df, df.where("vec_id % 10 = 0"), 5).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    for query in [*range(0, 300, 10), 1000, 1010]:
        own = [(i, np.array(v)) for i, v in rows if i != query and (i >= 1000) == (query >= 1000)]
        q = np.array(dict(rows)[query])
        scores = neighbours.cosine(q, np.stack([v for _, v in own]))
        want = sorted(zip(-scores, [i for i, _ in own]))[:5]
        assert got[query] == {n: (i, -s) for n, (s, i) in enumerate(want, 1)}
    assert len(got) == 32


@pytest.mark.parametrize("block", [5])
def test_large_groups_lose_no_link(spark, monkeypatch, block):
    """Groups of near copies far above a block, some of whose links no hub has, against brute force."""
    monkeypatch.setattr(neardup, "BUCKET_BLOCK", block)
    monkeypatch.setattr(neardup, "GROUP_BLOCK", block)
    rng = np.random.default_rng(4)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 400)]
    texts = []
    for k in range(60):  # a chain that drifts away from its beginning, and copies with a word or two changed
        near = list(base)
        for at in range(0, 5 * (k // 6), 5):
            near[at] = f"drift{at}"
        near[399 - k] = "changed"
        texts.append(" ".join(near))
    texts += [" ".join([*base[:200], *(f"z{x}" for x in rng.integers(0, 10**6, 200))]) for _ in range(5)]
    rows = list(enumerate(texts)) + [(7, texts[61]), (7, texts[7]), (500, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for alike, percent in ((neardup.OP4, 85), (neardup.GENERAL, 80)):
        got = {(r.doc_id, r.component_id) for r in neardup.near_duplicates(docs, alike).collect()}
        assert got == set(brute_groups(rows, percent).items())
