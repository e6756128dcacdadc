"""The stages one after the other against plain Python, on awkward rows and on an empty table."""

from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from sievecraft.llm import decontamination, neardup, packing
from tests.llm.data import SCHEMA, awkward_texts, empty, saved
from tests.llm.test_operators import brute_cut, brute_groups, shingles


def corpus(spark, folder):
    rng = np.random.default_rng(11)
    word = lambda n: [f"v{x}" for x in rng.integers(0, 3000, n)]
    items = [" ".join(word(20)) + ". " + " ".join(word(10)) + "." for _ in range(5)]
    texts = awkward_texts() + [" ".join(word(60)) for _ in range(150)]
    toxic = [" ".join([*word(20), "nastyone", *word(10), "nastytwo", *word(10)]) for _ in range(60)]
    leaks = [" ".join(word(30)) + " " + items[k % 5] + " " + " ".join(word(30)) for k in range(12)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts + toxic + leaks)]
    first_toxic = len(texts)
    labels = [(i, 1, int(first_toxic <= i < first_toxic + len(toxic))) for i in range(0, len(rows), 2)]
    rows += [rows[8], (None, texts[8], None, None, None)]
    spark.createDataFrame(rows, SCHEMA + "").selectExpr("*", "'own' AS score", "'own' AS toxic_score", "1 AS component_id").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), set(range(first_toxic, first_toxic + len(toxic))), items


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(spark, tmp_path):
    folder, toxic, items = corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, at = docs.columns, {"documents": docs}
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path}/out-{name}"
        stage(spark, before, folder).write.parquet(path)
        before = at[name] = spark.read.parquet(path)
    assert all(at[n].columns == columns for n in ("toxicity", "near_dedup", "substring_dedup", "decontamination"))

    rows = pairs(docs)
    assert Counter(pairs(at["toxicity"])) == Counter(r for r in rows if r[0] not in toxic)

    rows = pairs(at["toxicity"])
    group = brute_groups(rows, 80)
    kept = {r for r in rows if r[0] is None or not shingles(r[1]) or group[r[0]] == r[0]}
    assert Counter(pairs(at["near_dedup"])) == Counter({r: 1 for r in kept})

    rows = pairs(at["near_dedup"])
    want = brute_cut(rows)
    cut = pairs(at["substring_dedup"])
    assert len(cut) == len(rows) and sum(gone for _, _, gone, _ in want.elements()) > 0
    texts = dict((i, t) for i, t in rows if i is not None)
    for i, t in cut:
        if i is not None and len((t or "").split()) == len((texts[i] or "").split()):
            assert t == texts[i]
    left = Counter((i, len((t or "").encode().split())) for i, t in cut)
    assert left == Counter({(i, n - gone): k for (i, n, gone, _), k in want.items()})

    held = [i for i, t in cut if any(decontamination.shingles(decontamination.terms_of(x)) <= decontamination.shingles(decontamination.terms_of(t or "")) for x in items)]
    assert held and Counter(pairs(at["decontamination"])) == Counter(r for r in cut if r[0] not in held)

    lengths = defaultdict(int)
    for r in at["packing"].collect():
        lengths[r.doc_id] += r.length
    want_lengths = defaultdict(int)
    for i, t in pairs(at["decontamination"]):
        want_lengths[i] += len(packing.ids_of(t or ""))
    assert lengths == want_lengths


@pytest.mark.parametrize("only_ids_missing", [False, True])
def test_run_on_nothing(spark, tmp_path, only_ids_missing):
    saved(empty(spark), tmp_path)
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0 if not only_ids_missing else 5).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_dedup_links_from_080(spark, tmp_path):
    """Planted pairs between 0.80 and 0.85 lose their later document in the stage; op4 at 0.85 keeps both."""
    rng = np.random.default_rng(8)
    texts = []
    for k in range(120):
        text = [f"p{x}" for x in rng.integers(0, 10**6, 204)]  # 200 shingles
        near = list(text)
        for at in range(10, 10 + 20 * (3 + k % 3), 20):  # 3, 4 or 5 words, 15, 20 or 25 shingles of either side
            near[at] = "changed"
        texts += [" ".join(text), " ".join(near)]
    rows = list(enumerate(texts))
    sets = [shingles(t) for t in texts]
    share = [100 * len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, len(sets), 2)]
    assert sum(80 <= s < 85 for s in share) == 40 and sum(75 < s < 80 for s in share) == 40 and sum(s >= 85 for s in share) == 40
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()}
    assert got == {i for i, _ in rows} - {2 * k + 1 for k, s in enumerate(share) if s >= 80}
    groups = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, neardup.OP4).collect()}
    assert groups == {i: i - 1 if i % 2 and share[i // 2] >= 85 else i for i, _ in rows}
    assert all((1 - a.share**neardup.ROWS) ** a.bands < 1e-6 for a in (neardup.OP4, neardup.GENERAL))
