"""Suffix arrays, phrases and spelling variants against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievecraft.llm import phrases, repeats, variants
from sievecraft.llm.suffix_array import Passages, common_prefixes, suffix_array
from tests.llm.data import awkward_texts, documents, empty, saved


# --- suffix arrays


@pytest.mark.parametrize("alphabet", [b"a", b"\0a", b"ab\xff", bytes(range(97, 123))])
def test_suffix_array_and_common_prefixes(alphabet):
    rng = random.Random(len(alphabet))
    for _ in range(60):
        own = [bytes(rng.choice(alphabet) for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(1, 6))]
        own += own[: rng.randrange(2)]
        # separators are smaller than every byte, and each is another symbol
        symbols = [s for i, p in enumerate(own) for s in (*(b + len(own) for b in p), i)]
        order = sorted(range(len(symbols)), key=lambda i: symbols[i:])
        text = Passages(own)
        assert suffix_array(text).tolist() == order
        before, length = common_prefixes(text, suffix_array(text))
        for x, y in zip(order, order[1:]):
            n = 0
            while max(x, y) + n < len(symbols) and symbols[x + n] == symbols[y + n]:
                n += 1
            assert (before[y], length[y]) == (x, n)


def test_common_prefix_of_long_texts():
    rng = random.Random(3)
    one = rng.randbytes(30_000)
    text = Passages([one, one[:20_000] + b"!" + one[20_001:], one])
    before, length = common_prefixes(text, suffix_array(text))
    assert length[:30_000].max() == 30_000 or length[60_002:].max() == 30_000


# --- op11


def brute_repeats(texts, window):
    where = {}
    for i, text in enumerate(texts):
        for at in range(len(text) - window + 1):
            where.setdefault(text[at : at + window], []).append((i, at))
    gone = [bytearray(len(t)) for t in texts]
    for places in where.values():
        if len(places) > 1:
            for i, at in places:
                gone[i][at : at + window] = b"\1" * window
    return gone


def expected_repeats(rows):
    data = [(t or "").encode() for _, t in rows]
    out = Counter()
    for (doc_id, _), text, gone in zip(rows, data, brute_repeats(data, repeats.WINDOW)):
        kept = bytes(b for b, g in zip(text, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[doc_id, len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def repeating_texts():
    rng = random.Random(11)
    letters = "abcdefghij é"
    shared = ["".join(rng.choice(letters) for _ in range(n)) for n in (190, 205, 260, 420, 2500)]
    texts = awkward_texts()
    for s in shared:
        for n in (0, 1, 150, 300):
            texts.append("".join(rng.choice(letters) for _ in range(n)) + s + "".join(rng.choice(letters) for _ in range(n)))
    twice = shared[2] + "between" + shared[2]
    return [*texts, twice, "ab" * 101, "ab" * 100, "z" * 201, "z" * 200, "z" * 199, "\0" * 700, shared[4] + "tail", "head" + shared[4][:300]]


@pytest.mark.parametrize("home_bytes", [repeats.HOME_BYTES, 700])
def test_op11_equals_brute_force(spark, tmp_path, monkeypatch, home_bytes):
    monkeypatch.setattr(repeats, "HOME_BYTES", home_bytes)
    docs = documents(spark, repeating_texts())
    got = repeats.op11_two_stage_suffix_dedup(spark, saved(docs, tmp_path)).collect()
    want = expected_repeats([(r.doc_id, r.text) for r in docs.collect()])
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert any(k[2] for k in want) and any(not k[2] for k in want)


def test_op11_keeps_columns_and_takes_no_rows(spark, tmp_path):
    docs = documents(spark, ["once " * 100, "other text"], repeated=False).withColumn("k1", F.lit("own"))
    got = repeats.deduplicated(docs.withColumn("kept", F.lit("own")))
    assert {(r.k1, r.text[:4], bytes(r.kept)) for r in got.collect()} == {("own", "once", b""), ("own", "othe", b"other text")}
    assert repeats.op11_two_stage_suffix_dedup(spark, saved(empty(spark), tmp_path)).count() == 0


def test_long_texts_are_hashed_in_stretches(monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice("ab") for _ in range(3000)).encode()
    whole = {}
    for _, anchor, low, high, _ in zip(*repeats.anchors_of([text])):
        whole |= dict.fromkeys(range(low, high + 1), anchor)
    parts = {}
    for begin in range(0, len(text) - repeats.WINDOW + 1, 512):
        for _, anchor, low, high, _ in zip(*repeats.anchors_of([text[begin : begin + 512 + repeats.WINDOW - 1]])):
            parts |= dict.fromkeys(range(begin + low, begin + high + 1), anchor)
    assert whole == parts and len(whole) == len(text) - repeats.WINDOW + 1


# --- op12


def brute_phrases(rows, least, top):
    counts, n = Counter(), Counter()
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(fold)):
            own = re.findall("[^ \t]+", piece)
            n[lang] += len(own)
            for k in range(1, 6):
                counts.update((lang, tuple(own[i : i + k])) for i in range(len(own) - k + 1))
    found = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    out = []
    for lang in n:
        ranked = []
        for (own, p), a in found.items():
            if own != lang:
                continue
            inside = [q for (o, q), b in found.items() if o == lang and len(q) > len(p) and b >= a]
            if any(q[i : i + len(p)] == p for q in inside for i in range(len(q) - len(p) + 1)):
                continue
            cuts = [(1000 * a * n[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            ranked.append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def phrase_texts():
    rng = random.Random(12)
    common = ["New York city", "as far as I know", "in spite of", "ici, là", "a b", "a b c d e f", "Été \x1c x"]
    texts = []
    for _ in range(120):
        own = [rng.choice(common) if rng.random() < 0.4 else f"w{rng.randrange(30)}" for _ in range(rng.randrange(60))]
        texts.append("".join(w + rng.choice([" ", " ", " ", "\t", ". ", "\n", "  "]) for w in own))
    return [*awkward_texts(), *texts, "again " * 500, ". , ; !", "a b " * 300]


@pytest.mark.parametrize(("least", "top"), [(3, 50), (8, 2000)])
def test_phrases_equal_brute_force(spark, least, top):
    docs = documents(spark, phrase_texts())
    got = phrases.collocations(docs, least=least, top=top).collect()
    want = brute_phrases([(r.lang, r.text) for r in docs.collect()], least, top)
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == want
    assert {w[0] for w in want} == {"en", "und"}


def test_hot_prefixes_are_cut_and_merged(spark, monkeypatch):
    docs = documents(spark, phrase_texts())
    one = {tuple(r) for r in phrases.phrase_counts(docs, least=3)[0].collect()}
    monkeypatch.setattr(phrases, "HOT_SHARE", 10**9)
    assert one and {tuple(r) for r in phrases.phrase_counts(docs, least=3)[0].collect()} == one
    # a bitmap that is full prunes nothing and changes nothing, nor does counting a few texts at a time
    assert {tuple(r) for r in phrases.phrase_counts(docs, least=3, bits=6, held_bytes=3000)[0].collect()} == one


def test_scores_beyond_64_bits(spark, monkeypatch):
    big = 3 * 10**12
    rows = [("en", "a", 1, big), ("en", "b", 1, big + 1), ("en", "a b", 2, big - 7)]
    counts = spark.createDataFrame(rows, "lang string, phrase string, words int, f long")
    sums = spark.createDataFrame([("en", 17 * 10**12)], "lang string, n long")
    monkeypatch.setattr(phrases, "phrase_counts", lambda *_: (counts, sums))
    (row,) = phrases.collocations(documents(spark)).collect()
    assert row.score == 1000 * (big - 7) * 17 * 10**12 // (big * (big + 1))


def test_op12_of_no_rows(spark, tmp_path):
    assert phrases.op12_stripes_collocations(spark, saved(empty(spark), tmp_path)).count() == 0


# --- op13


def brute_words(rows):
    counts = Counter()
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(fold)
            h = zlib.crc32(f"{doc_id}:{run}".encode()) if doc_id is not None else 1
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts, ratio=10):
    form, found = {}, {}
    for w, n in counts.items():
        own = [v for v in counts if v != w and near(v, w)]
        best = min(own, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
        found[w] = len(own)
    out = set()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, found[w], counts.get(form[w])))
    return out


def spelt_texts():
    rng = random.Random(13)
    base = ["responsible", "committee", "aaaaaaaaa", "élèvesx", "possession", "×÷×÷×÷×", "abababab"]
    texts = [*awkward_texts()]
    for _ in range(150):
        own = []
        for _ in range(30):
            w = rng.choice(base)
            if rng.random() < 0.1:
                i = rng.randrange(len(w))
                w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abé") + w[i:], w[:i] + "x" + w[i + 1 :]])
            own.append(rng.choice([w, w.upper(), w.capitalize()]))
        texts.append(rng.choice([" ", "-", "1"]).join(own))
    return [*texts, "q" * 3000 + " " + "q" * 2999 + " " + "q" * 3000 + " " + "q" * 2999]


def test_op13_equals_brute_force(spark, tmp_path):
    docs = documents(spark, spelt_texts())
    got = variants.op13_trie_pair_variants(spark, saved(docs, tmp_path)).collect()
    want = brute_variants(brute_words([(r.doc_id, r.text) for r in docs.collect()]))
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want and len(got) == len(want)
    assert any(w[1] for w in want) and len(want) > 100


def test_variants_follow_forms_to_roots(spark):
    words = [("aaaaaaaa", 1), ("aaaaaaab", 10), ("aaaaaabb", 100), ("aaaaabbb", 1000), ("aaaabbbb", 10_000), ("zzzzzzz", 5)]
    words += [("a" * 6 + c, 3) for c in "cdefg"] + [("bookkeper", 2), ("bookkeeper", 2), ("bokkeeper", 20)]
    got = variants.variant_groups(spark.createDataFrame(words, "word string, n long").repartition(4)).collect()
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == brute_variants(dict(words))


def test_op13_of_no_rows(spark, tmp_path):
    assert variants.op13_trie_pair_variants(spark, saved(empty(spark), tmp_path)).count() == 0
