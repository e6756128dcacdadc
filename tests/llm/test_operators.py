"""Each operator against plain Python on awkward rows, and on an empty table."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievecraft.llm import (
    chat,
    decontamination,
    language_model,
    neardup,
    neighbours,
    packing,
    quality,
    sharding,
    substrings,
    toxicity,
)
from sievecraft.llm.components import components
from tests.check_oracle import duck, rows_of
from tests.llm.data import awkward_texts, documents, empty, saved

TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    folder = saved(documents(spark), tmp_path_factory.mktemp("docs"))
    return folder, [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("nothing")
    saved(empty(spark), folder)
    for name in ("benchmark", "labels", "conversations", "embeddings"):
        spark.read.parquet(f"{TINY}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def key(value):
    return (value is None, value)


# 1


def test_ids_equal_those_of_the_json_file():
    import public_tokenizers
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in awkward_texts():
        want = other.encode(text or "", add_special_tokens=False).ids + [1]
        assert packing.ids_of(text or "").tolist() == want


def test_packing(spark, docs):
    folder, rows = docs
    out = packing.op1_vector_packing(spark, folder).collect()
    ids = defaultdict(list)
    for doc_id, text in rows:
        ids[doc_id].append(packing.ids_of(text or ""))
    pieces = Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out)
    want = Counter(
        (doc_id, s, len(i[s : s + 2048]), zlib.crc32(i[s : s + 2048].tobytes()), len(i))
        for doc_id, every in ids.items() for i in every for s in range(0, len(i), 2048)
    )
    assert pieces == want
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(r.length for r in out) >= 0.8 * 2048 * (len(sequences) - 1)


def test_packing_limits_and_sequences(spark):
    rng = np.random.default_rng(0)
    sizes = np.stack([rng.integers(1, 400, 300), np.ones(300, int), rng.integers(0, 200, 300)], axis=1)
    bins, offsets = packing.fill_bins(sizes, np.array([1000, 5, 300]))
    for b in np.unique(bins):
        assert (sizes[bins == b].sum(axis=0) <= [1000, 5, 300]).all()
    with pytest.raises(ValueError):
        packing.fill_bins(np.array([[5, 1, 5]]), np.array([4, 9, 9]))
    docs = spark.createDataFrame([(i, "word " * i) for i in range(40)], "doc_id long, text string")
    rows = packing.sequences(packing.pack(packing.pieces_of(docs))).collect()
    for r in rows:
        n = sum(r.segment_lengths)
        assert len(r.input_ids) == (n if n & (n - 1) == 0 else 2048)
    assert sum(sum(r.segment_lengths) for r in rows) == sum(len(packing.ids_of("word " * i)) for i in range(40))


# 2 and 10


def labelled(spark, folder, n=300):
    """Documents of which every third is toxic and every fourth is bad, by their words."""
    rows, labels = [], []
    rng = np.random.default_rng(3)
    for i in range(n):
        text = [f"w{x}" for x in rng.integers(0, 300, 40)]
        if i % 3 == 0:
            text[5], text[20] = "nastyone", "nastytwo"
        if i % 4 == 0:
            text = ["|", "$$$"] * 20 + text[:8] if i % 3 else ["|", "$$$"] * 20 + text
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 4 != 0), int(i % 3 == 0)))
    rows += [(None, None), (n, ""), (n, "nastyone"), (n + 1, rows[0][1])]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit(7)).write.parquet(f"{folder}/documents.parquet")
    # nulls, a contradiction and a label without a document
    labels += [(None, 1, 1), (3, None, None), (1, 1, 1), (10**9, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows


@pytest.mark.parametrize("query, threshold", [(toxicity.op2_crf_toxicity, 0.5), (quality.op10_pu_quality, 0.3)])
def test_classifiers(spark, tmp_path, query, threshold):
    folder, rows = labelled(spark, tmp_path)
    out = query(spark, folder).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in rows)
    held, right = 0, 0
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= threshold)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.held_out and r.doc_id < 300:
            held += 1
            right += r.predicted == (r.doc_id % 3 == 0 if threshold == 0.5 else r.doc_id % 4 != 0)
    # the quality scorer sees no bad labels, so it may miss more
    assert held > 30 and right >= (0.95 if threshold == 0.5 else 0.85) * held


def test_spans_are_offsets(spark, tmp_path):
    folder, rows = labelled(spark, tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    field = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    for r in toxicity.scored(docs.where("doc_id in (6, 7, 9)"), field).collect():
        found = {r.text[s.start : s.stop] for s in r.toxic_spans}
        assert found == (set() if r.doc_id == 7 else {"nastyone", "nastytwo"})


def test_marginals_by_enumeration():
    rng = np.random.default_rng(5)
    emission, move, first = rng.normal(size=(1, 5)), rng.normal(size=(2, 2)), rng.normal(size=2)
    valid = np.array([[True, True, True, True, False]])
    total, toxic = 0.0, np.zeros(4)
    for code in range(16):
        y = [code >> i & 1 for i in range(4)]
        w = math.exp(first[y[0]] + sum(emission[0, i] * y[i] for i in range(4)) + sum(move[y[i], y[i + 1]] for i in range(3)))
        total += w
        toxic += w * np.array(y)
    got, _, log_total = toxicity.marginals(emission, valid, move, first)
    assert np.allclose(got[0, :4], toxic / total) and math.isclose(log_total, math.log(total))


# 3


def test_language_model(spark, docs):
    folder, rows = docs
    out = language_model.op3_elias_fano_lm(spark, folder).collect()
    tokens = [((i, t), [w for w in (t or "").encode().lower().split()] + [None]) for i, t in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    one, two = Counter(), Counter()
    for (i, _), w in tokens:
        if not held(i):
            one.update(w)
            two.update(zip([0, *w[:-1]], w))
    n, v, mass = sum(one.values()), len(one), language_model.MASS
    p = lambda w: (one[w] + 0.5) / (n + 0.5 * (v + 1))
    c = lambda h: one[None] if h == 0 else one[h]
    want = Counter()
    for (i, _), w in tokens:
        base = sum(math.log10(p(x)) for x in w)
        score = sum(math.log10((two[a, x] + mass * p(x)) / (c(a) + mass)) for a, x in zip([0, *w[:-1]], w))
        want[(i, held(i), len(w), sum(one[x] > 0 for x in w), n, round(base, 6))] += 1
        want[("score", i, round(score / len(w), 2))] += 1
    got = Counter()
    for r in out:
        got[(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))] += 1
        got[("score", r.doc_id, round(r.score / r.n_tokens, 2))] += 1
    assert got == want


# 4


def shingles(text):
    w = (text or "").encode().lower().split()
    k = min(5, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def brute_groups(rows, percent=85):
    """Smallest id by id, over rows that share an id or are alike."""
    nodes = sorted({i for i, _ in rows if i is not None})
    root = {i: i for i in nodes}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return {i: find(i) for i in nodes}


def test_near_duplicates(spark, docs):
    folder, rows = docs
    out = neardup.op4_setsketch_neardup(spark, folder).collect()
    group = brute_groups(rows)
    empty_of = lambda t: not shingles(t)
    want = Counter(
        (i, len(shingles(t)), i if i is None or empty_of(t) else group[i], i is None or (i == (i if empty_of(t) else group[i])))
        for i, t in rows
    )
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out) == want


def test_large_groups_in_tiles(spark, monkeypatch):
    """A third of all rows are near copies: small blocks make many tiles, and the result stays."""
    rng = np.random.default_rng(2)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(60):
        text = list(base)
        text[int(rng.integers(0, 60))] = f"x{i % 7}"
        rows.append((i, " ".join(text) if i % 3 == 0 else " ".join(f"r{x}" for x in rng.integers(0, 10**6, 30))))
    monkeypatch.setattr(neardup, "BUCKET_BLOCK", 3)
    monkeypatch.setattr(neardup, "GROUP_BLOCK", 3)
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    group = brute_groups(rows)
    assert {r.doc_id: r.component_id for r in out} == group


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 1 << 63, 4000, dtype=np.uint64), rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    both = np.concatenate([a, b])
    assert (neardup.merged(neardup.registers_of(a), neardup.registers_of(b)) == neardup.registers_of(both)).all()
    for share in (0.5, 0.85, 1.0):
        c = np.concatenate([a[: int(share * 4000)], b[: 4000 - int(share * 4000)]])
        x, y = neardup.registers_of(a), neardup.registers_of(c)
        real = len(np.intersect1d(a, c)) / len(np.union1d(a, c))
        got = neardup.likely_similarity(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([4000]), np.array([4000]))
        assert abs(got[0] - real) < 4 * math.sqrt(0.25 / neardup.REGISTERS)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7), (200, None), (300, 250)] + [(500, k) for k in range(501, 560)]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    got = {r.node: r.component for r in found}
    want = {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100, 250: 250, 300: 250, **{k: 500 for k in range(500, 560)}}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 5


def test_neighbours(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(400)]
    same = rows[50][1]
    rows += [(i, list(same)) for i in range(400, 500)] + [(50, list(same))]  # ties, and a repeated id
    rows += [(600, None), (601, []), (650, [0.0] * 8), (603, [1.0, None] * 4), (604, [float("nan")] * 8), (605, [float("inf")] * 8), (None, list(same)), (700, [1e-30] * 8), (701, [1.0] * 4)]
    path = saved(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1)), tmp_path, "embeddings")
    got = defaultdict(list)
    for r in neighbours.op5_int8_block_neighbours(spark, path).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(np.array(v))]
    for q, v in good:
        if q % 50 == 0:
            near = sorted((-float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), i) for i, w in good if i != q and len(w) == len(v))
            want = near[:5]
            assert [r[0] for r in sorted(got[q])] == list(range(1, len(want) + 1))
            assert np.allclose([-s for s, _ in want], [r[2] for r in sorted(got[q])], atol=1e-12)
    assert [i for _, i, _ in sorted(got[50])] == [400, 401, 402, 403, 404]
    assert set(got) == {q for q, v in good if q % 50 == 0 and len(v) == 8}


# 6


def brute_cut(rows):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for s in range(len(w) - 49):
            if i is not None:
                k = tuple(w[s : s + 50])
                first[k] = min(first.get(k, i), i)
    out = Counter()
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - 49):
            if i is not None and first.get(tuple(w[s : s + 50]), i) < i:
                gone[s : s + 50] = [True] * 50
        kept = [x for x, g in zip(w, gone) if not g]
        out[(i, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())] += 1
    return out


@pytest.mark.parametrize("limits", [(100_000, 50_000), (60, 100)])
def test_substrings(spark, docs, monkeypatch, limits):
    """Also with shards copied for every few words asked and cut into tiny automata."""
    monkeypatch.setattr(substrings, "ASKING", limits[0])
    monkeypatch.setattr(substrings, "AUTOMATON", limits[1])
    folder, rows = docs
    out = substrings.op6_substring_dedup(spark, folder).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out) == brute_cut(rows)


def test_automaton():
    rng = np.random.default_rng(7)
    passages = [rng.integers(0, 4, 30).tolist() for _ in range(3)]
    automaton, text = substrings.SuffixAutomaton(passages), rng.integers(-1, 4, 60).tolist()
    runs = {tuple(p[i:j]) for p in passages for i in range(30) for j in range(i + 1, 31)}
    want = [max((n for n in range(1, i + 2) if tuple(text[i + 1 - n : i + 1]) in runs), default=0) for i in range(60)]
    assert automaton.statistics(text).tolist() == want


# 7 and 8


def test_rotation_equals_sql(spark):
    con = duck(TINY).execute(chat.OP7_SQL)
    want = rows_of([c[0] for c in con.description], con.fetchall())
    df = chat.op7_perspective_rotation(spark, TINY)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want


def test_rotation_of_awkward_turns(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, None, "who?"), (1, 2, "bob", None), (2, None, "ann", "x"), (3, 0, "system", "alone"), (None, 0, "bob", "lost")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("speaker", F.lit("own"))
    out = {(r.conv_id, r.speaker): r for r in chat.rotate(df).collect()}
    assert set(out) == {(1, "ann"), (1, "bob"), (1, "unknown"), (2, "ann"), (None, "bob")}
    r = out[1, "bob"]
    assert r.text == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user name=ann\nhi<|im_end|>\n" + "<|im_start|>assistant\n<|im_end|>\n" * 2 + "<|im_start|>user name=unknown\nwho?<|im_end|>\n"
    assert [r.text[s.start : s.stop] for s in r.mask] == ["<|im_end|>\n"] * 2


def test_rotation_of_crowds(spark):
    """Many copies of one turn, and many texts of one turn number, are dealt into examples; every row is rendered."""
    rows = [(1, 0, "ann", "again")] * 700 + [(1, 5, "bob", f"t{i}") for i in range(900)] + [(2, 0, "ann", "hi")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.rotate(df).collect()
    assert sum(len(r.mask) for r in out) == len(rows)
    assert max(r.n_turns for r in out) < 700


def brute_rotation(rows, range_turns):
    """(conv_id, block, speaker) -> text and what bears loss, of whole dialogues in consecutive ranges."""
    talks, out = defaultdict(list), {}
    for conv, turn, role, text in rows:
        talks[conv].append((turn is not None, turn or 0, role, text))
    for conv, said in talks.items():
        said.sort()
        for speaker in {role for _, _, role, _ in said} - {"system"}:
            for at in range(0, len(said), range_turns):
                text, loss = "", []
                for _, _, role, words in said[at : at + range_turns]:
                    head = "system" if role == "system" else "assistant" if role == speaker else f"user name={role}"
                    text += f"<|im_start|>{head}\n{words}<|im_end|>\n"
                    loss += [f"{words}<|im_end|>\n"] * (role == speaker)
                out[conv, at // range_turns, speaker] = text, loss
    return out


@pytest.mark.parametrize("range_turns", [None, 16])
def test_rotation_of_long_dialogues(spark, range_turns):
    """More than 64 turn numbers, a speaker heard once, copies and crowds: every participant gets all of it, in order."""
    rows = [(1, k, ("system", "ann", "bob")[k % 3], f"n{k}") for k in range(200)] + [(1, 3, "cy", "once")]
    rows += [(2, 0, "ann", "again")] * 40 + [(2, 5, ("bob", "dee")[k % 2], f"t{k}") for k in range(300)]
    rows += [(3, None, "ann", "x"), (3, 0, "bob", "y")] + [(None, k, f"r{k % 4}", "lost") for k in range(100)]
    rows += [(4, 0, "system", "alone")] * 50
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    out = (chat.rotate(df) if range_turns is None else chat.rotate(df, range_turns)).collect()
    got = {(r.conv_id, r.block, r.speaker): (r.text, [r.text[s.start : s.stop] for s in r.mask]) for r in out}
    assert len(got) == len(out) and got == brute_rotation(rows, range_turns or chat.RANGE)


def test_sharding(spark, docs):
    folder, rows = docs
    out = sharding.op8_rendezvous_shards(spark, folder).collect()
    data = [((i, (t or "").encode())) for i, t in rows]
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len(t) + 1, zlib.crc32(t)) for i, t in data)
    slots = defaultdict(list)
    place = {}
    for r in out:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and r.grown_shard in (r.shard, 16) and 0 <= r.shard < 16
        assert place.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weighted_shards_and_hot_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLICE", 50)
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 20)
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"))
    out = sharding.with_slots(sharding.with_shards(rows, "k", [1.0, 3.0, 0.0]), 3).toPandas()
    assert len(out) == 6000 and (out.groupby("shard").slot.apply(lambda s: sorted(s) == list(range(len(s))))).all()
    share = (out.drop_duplicates("k").shard == 1).mean()
    assert 0.7 < share < 0.8 and not (out.shard == 2).any()


# 9


def test_decontamination(spark, tmp_path):
    rng = np.random.default_rng(8)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 500, n)]
    items = [" ".join(word(25)).capitalize() + ". " + " ".join(word(12)) + "." for _ in range(60)]
    items += [items[0], "too short", "", None]
    docs = []
    for i in range(200):
        text = word(int(rng.integers(0, 150)))
        if i % 5 == 0:
            text[len(text) // 2 : len(text) // 2] = items[i % 60].upper().replace(".", " !").split()
        if i % 7 == 0:
            text += items[(i + 1) % 60].split()[:18]  # half an item is no contamination
        docs.append((i, " ".join(text)))
    docs += [(None, items[3]), (500, None), (501, ""), (502, "it is too short, really"), (503, items[4]), (503, items[4])]
    folder = saved(spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(5)), tmp_path)
    saved(spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), tmp_path, "benchmark")
    got = {(r.doc_id, r.item_id) for r in decontamination.op9_bm25_decontamination(spark, folder).collect()}
    want = set()
    for doc_id, text in docs:
        w = decontamination.terms_of(text or "")
        for n, item in enumerate(items):
            question, answer = decontamination.question_and_answer(item or "")
            shares = []
            for part in (item or "", question, answer):
                s = decontamination.shingles(decontamination.terms_of(part))
                own = {tuple(w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1)}
                shares.append(len(s & own) / len(s) if s else 0)
            if shares[0] >= 0.8 or (shares[1] >= 0.8 and shares[2] >= 0.5):
                want.add((doc_id, n))
    assert got == want
    monkey = [i for i in decontamination.indexes(spark.read.parquet(f"{folder}/benchmark.parquet"), 7)]
    assert sum(len(i.items) for i in monkey) == 63 and max(len(i.items) for i in monkey) == 7
    clean = decontamination.decontaminated(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet"))
    assert clean.columns == ["doc_id", "text", "item_id"]
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_block_max_search_finds_all():
    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.4, 20) % 200) for _ in range(90)]
    index = decontamination.Index(list(enumerate(texts)))
    for text in texts[:20]:
        terms = np.unique(index.ids_of(text + " w1 w2 w3 other"))
        terms = terms[terms < len(index.terms)]
        for threshold in (0.3, 0.6, 0.9):
            items, scores = index.search(np.zeros(len(terms), np.int64), terms, threshold)
            full = np.zeros(len(texts))
            term = np.repeat(np.arange(len(index.terms)), np.diff(index.postings_at[index.blocks_at]))
            for t, i, w in zip(term, index.item, index.impact):
                full[i] += w * (t in terms)
            assert set(items.tolist()) == set(np.flatnonzero(full >= threshold - 1e-9).tolist())


# all


QUERIES = [
    packing.op1_vector_packing, toxicity.op2_crf_toxicity, language_model.op3_elias_fano_lm, neardup.op4_setsketch_neardup,
    neighbours.op5_int8_block_neighbours, substrings.op6_substring_dedup, chat.op7_perspective_rotation,
    sharding.op8_rendezvous_shards, decontamination.op9_bm25_decontamination, quality.op10_pu_quality,
]


@pytest.mark.parametrize("query", QUERIES, ids=lambda q: q.__name__)
def test_empty_tables(spark, nothing, query):
    assert query(spark, nothing).count() == 0


@pytest.mark.parametrize("query", [toxicity.op2_crf_toxicity, quality.op10_pu_quality], ids=lambda q: q.__name__)
def test_no_labels(spark, docs, nothing, tmp_path, query):
    spark.read.parquet(f"{docs[0]}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{nothing}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert query(spark, str(tmp_path)).count() == len(docs[1])
