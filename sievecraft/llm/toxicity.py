"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Training takes a bounded sample of labelled documents. Tokens of toxic ones are labelled toxic if the word, or one of its
beginnings, is in documents labelled toxic many times as often as in the others; all other tokens are labelled clean. The
field has a weight for each hashed feature of a token (the word, its beginnings and its end), and for each pair of
neighbouring labels; it is fitted by gradient ascent on the likelihood, with forward-backward for the expectations.

A text is scored whole. It is laid out in chains of ``CHAIN`` tokens, between which forward and backward messages pass, so
where it is cut does not matter. Forward-backward gives each token's probability of being toxic, and a logistic of the largest one and of their sum gives the document's score. Spans are runs of tokens of
probability 1/2 or more, by character offset.

Defined results: a null or empty text has the score of no evidence, and no spans; equal texts get equal scores; a document
with contradicting labels counts as both; without labelled rows of both kinds every score is the share of toxic ones (0
without any); rows with null or repeated ids are scored each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecraft.llm.text import PLACES, held_out, labelled_sample, lower_ascii, shingle_set, table, texts_of
from sievecraft.shipping import ship

#: Documents of each class that training takes at most; tokens in a chain; hashed features; words remembered at once.
PER_CLASS, CHAIN, BUCKETS, REMEMBERED = 700, 64, 1 << 18, 400_000
#: A feature marks toxic tokens if in so many different toxic texts, in this share of them, and so many times as often as in others,
LEAST_DOCS, LEAST_SHARE, TIMES = 3, 0.03, 40.0
#: and if the others' rate would bring so many texts with no more than this chance.
CHANCE = 1e-7
TOKEN = re.compile(r"\S+")
N_FEATURES = 7
#: Of a token's features, those that may mark it: the word and its beginnings of 4 letters and more.
MARKING = [0, 2, 3, 4]


def features_of(token: str) -> list[int]:
    """Buckets of the word without its outer marks, its beginnings of 3 to 6 letters and its last 3."""
    word = token.lower().strip("\"'.,;:!?()[]{}<>*#%&$|-_").encode("utf-8", "replace")
    text = word.decode("utf-8", "ignore")
    parts = (b"w" + word, *(b"p%d" % n + text[:n].encode() for n in (3, 4, 5, 6)), b"s" + text[-3:].encode(), b"bias")
    return [zlib.crc32(p) % BUCKETS for p in parts]


def chains(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and column of each token in a table of chains, and which chains open a text; a chain never crosses texts."""
    starts = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(starts, lengths)
    rows = np.cumsum(-(-lengths // CHAIN))
    rows_before = np.concatenate([[0], rows])[:-1]
    opens = np.zeros(rows[-1], bool)
    opens[rows_before[lengths > 0]] = True
    return np.repeat(rows_before, lengths) + place // CHAIN, place % CHAIN, opens


def marginals(
    emission: np.ndarray, valid: np.ndarray, move: np.ndarray, first: np.ndarray, opens: np.ndarray | None = None, with_pairs: bool = True
):
    """P(toxic) of each place, pairwise expectations summed, and the log likelihoods' normaliser.

    ``emission``: log weight of label 1 against label 0, by chain and place; ``move[a, b]`` and ``first[a]`` in logs. A chain
    that does not open a text (``opens``) goes on where the chain before it ends: messages pass from one to the next in both
    directions, so the result is that of the text as one chain.
    """
    n, width = emission.shape
    opens = np.ones(n, bool) if opens is None else opens
    weight = np.stack([np.ones_like(emission), np.exp(np.clip(emission, -30, 30))], axis=2)
    step, begin = np.exp(move), np.exp(first)
    enter, leave = messages(weight, valid, step, begin, opens)
    forward = np.empty((n, width, 2))
    scale = np.ones((n, width))
    state = np.where(opens[:, None], begin, enter @ step) * weight[:, 0]
    for t in range(width):
        if t:
            state = np.where(valid[:, t, None], (forward[:, t - 1] @ step) * weight[:, t], forward[:, t - 1])
        scale[:, t] = state.sum(axis=1)
        forward[:, t] = state / scale[:, t, None]
    backward = leave
    toxic = np.empty((n, width))
    pairs = np.zeros((2, 2))
    for t in range(width - 1, -1, -1):
        both = forward[:, t] * backward
        toxic[:, t] = both[:, 1] / both.sum(axis=1)
        ahead = weight[:, t] * backward
        if with_pairs:
            counted = valid[:, t] if t else ~opens
            joint = (forward[:, t - 1] if t else enter)[counted][:, :, None] * step * ahead[counted][:, None, :]
            pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        if t:
            passed = ahead @ step.T
            backward = np.where(valid[:, t, None], passed / passed.sum(axis=1, keepdims=True), backward)
    return toxic, pairs, float(np.log(scale).sum())


def messages(weight: np.ndarray, valid: np.ndarray, step: np.ndarray, begin: np.ndarray, opens: np.ndarray):
    """What each chain hears from the chains of its text before it (at their last place) and after it (at its own)."""
    n, width = valid.shape
    enter, leave = np.full((n, 2), 0.5), np.ones((n, 2))
    if opens.all():
        return enter, leave
    # of each chain, from the label before it to its last label; the label before an opening chain says nothing
    across = np.where(opens[:, None, None], begin, step) * weight[:, 0, None, :]
    for t in range(1, width):
        further = (across @ step) * weight[:, t, None, :]
        further /= further.sum(axis=(1, 2), keepdims=True)
        across = np.where(valid[:, t, None, None], further, across)
    number = np.arange(n) - np.maximum.accumulate(np.where(opens, np.arange(n), 0))
    order = np.argsort(number, kind="stable")
    ends = np.cumsum(np.bincount(number))
    for low, high in zip(ends[:-1], ends[1:]):
        rows = order[low:high]
        passed = np.einsum("ni,nij->nj", enter[rows - 1], across[rows - 1])
        enter[rows] = passed / passed.sum(axis=1, keepdims=True)
    for low, high in zip(ends[-2::-1], ends[:0:-1]):
        rows = order[low:high]
        passed = np.einsum("nij,nj->ni", across[rows], leave[rows])
        leave[rows - 1] = passed / passed.sum(axis=1, keepdims=True)
    return enter, leave


@dataclass
class Field:
    weights: np.ndarray
    move: np.ndarray
    first: np.ndarray
    #: Intercept and factors of the largest probability and of the log of their sum.
    scale: np.ndarray

    def __post_init__(self) -> None:
        self._known: dict[str, float] = {}

    def emissions(self, tokens: list[str]) -> np.ndarray:
        known, weights = self._known, self.weights
        if len(known) > REMEMBERED:
            known.clear()
        for token in set(tokens).difference(known):
            known[token] = float(weights[features_of(token)].sum())
        return np.fromiter(map(known.__getitem__, tokens), np.float64, len(tokens))

    def probabilities(self, texts: list[list[str]]) -> list[np.ndarray]:
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        if not lengths.sum():
            return [np.empty(0) for _ in texts]
        row, column, opens = chains(lengths)
        emission, valid = np.zeros((len(opens), CHAIN)), np.zeros((len(opens), CHAIN), bool)
        emission[row, column] = self.emissions([token for t in texts for token in t])
        valid[row, column] = True
        toxic, _, _ = marginals(emission, valid, self.move, self.first, opens, with_pairs=False)
        return np.split(toxic[row, column], np.cumsum(lengths)[:-1])

    def scores(self, probabilities: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-(evidence(probabilities) @ self.scale)))


def evidence(probabilities: list[np.ndarray]) -> np.ndarray:
    most = np.array([p.max(initial=0.0) for p in probabilities])
    total = np.array([p[p >= 0.05].sum() for p in probabilities])
    return np.stack([np.ones(len(most)), most, np.log1p(total)], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps of a logistic regression."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
    return w


def chance_of(count: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """A bound of the chance of ``count`` or more events where so many are expected (Chernoff's, for rare events)."""
    more = count > expected
    safe = np.maximum(count, 1)
    return np.where(more, np.exp(count - expected - count * np.log(safe / expected)), 1.0)


def without_families(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The rows that share none of four minimum shingle hashes with an earlier one of the same label."""
    seen: set[tuple] = set()
    out = []
    for text, label in rows:
        own = shingle_set(lower_ascii(text))
        marks = {(label, k, int((own * factor).min())) for k, factor in enumerate(PLACES[:4])} if len(own) else set()
        if not marks & seen:
            out.append((text, label))
        seen |= marks
    return out


def train(texts: list[str], labels: np.ndarray, rounds: int = 30) -> Field:
    """The field of these texts; copies and near copies of a text, which would make its own words look telling, count once."""
    distinct = without_families(sorted(set(zip(texts, labels.tolist()))))
    texts, labels = [t for t, _ in distinct], np.array([y for _, y in distinct], dtype=np.int64)
    share = float(labels.mean()) if len(labels) else 0.0
    if not 0 < share < 1:
        odds = np.log(share / (1 - share)) if share < 1 and share > 0 else (30.0 if share else -30.0)
        return Field(np.zeros(BUCKETS), np.zeros((2, 2)), np.zeros(2), np.array([odds, 0.0, 0.0]))
    docs = [TOKEN.findall(t) for t in texts]
    types: dict[str, int] = {}
    ids = [np.array([types.setdefault(t, len(types)) for t in d], dtype=np.int64) for d in docs]
    features = np.array([features_of(t) for t in types], dtype=np.int64).reshape(len(types), N_FEATURES)
    seen = np.zeros((2, BUCKETS))
    for i, label in zip(ids, labels):
        seen[label, np.unique(features[np.unique(i)][:, MARKING])] += 1
    size = np.bincount(labels, minlength=2)
    rate = (seen[0] + 0.5) / size[0]
    marks = (
        (seen[1] >= max(LEAST_DOCS, LEAST_SHARE * size[1]))
        & (seen[1] / size[1] >= TIMES * rate)
        & (chance_of(seen[1], rate * size[1]) < CHANCE)
    )
    marked = marks[features[:, MARKING]].any(axis=1)
    lengths = np.array([len(i) for i in ids], dtype=np.int64)
    if not lengths.sum():
        return Field(np.zeros(BUCKETS), np.zeros((2, 2)), np.zeros(2), np.array([np.log(share / (1 - share)), 0, 0]))
    token = np.concatenate(ids)
    target = marked[token] & (np.repeat(labels, lengths) == 1)
    row, column, opens = chains(lengths)
    valid, gold = np.zeros((len(opens), CHAIN), bool), np.zeros((len(opens), CHAIN))
    valid[row, column], gold[row, column] = True, target
    g = gold.astype(np.int64)
    both = valid[:, 1:] & valid[:, :-1]
    goes_on = np.flatnonzero(~opens)
    gold_pairs = np.bincount((2 * g[:, :-1] + g[:, 1:])[both], minlength=4)
    gold_pairs += np.bincount(2 * g[goes_on - 1, -1] + g[goes_on, 0], minlength=4)
    gold_pairs = gold_pairs.reshape(2, 2).astype(float)
    gold_first = np.bincount(g[opens, 0], minlength=2).astype(float)
    gold_types = np.bincount(token, weights=target, minlength=len(types))
    weights, move, first = np.zeros(BUCKETS), np.zeros((2, 2)), np.zeros(2)
    emission, moments = np.zeros_like(gold), [[np.zeros_like(p), np.zeros_like(p)] for p in (weights, move, first)]
    for k in range(1, rounds + 1):
        emission[row, column] = weights[features].sum(axis=1)[token]
        toxic, pairs, _ = marginals(emission, valid, move, first, opens)
        spread = gold_types - np.bincount(token, weights=toxic[row, column], minlength=len(types))
        slope = np.bincount(features.ravel(), weights=np.repeat(spread, N_FEATURES), minlength=BUCKETS)
        starts = np.array([(1 - toxic[opens, 0]).sum(), toxic[opens, 0].sum()])
        slopes = (slope - 0.05 * weights, gold_pairs - pairs - 0.05 * move, gold_first - starts - 0.05 * first)
        for p, d, m, rate in zip((weights, move, first), slopes, moments, (0.3, 0.1, 0.1)):
            m[0][:] = 0.9 * m[0] + 0.1 * d
            m[1][:] = 0.99 * m[1] + 0.01 * d * d
            p += rate * (m[0] / (1 - 0.9**k)) / (np.sqrt(m[1] / (1 - 0.99**k)) + 1e-6)
    field = Field(weights, move, first, np.zeros(3))
    field.scale = logistic(evidence(field.probabilities(docs)), labels.astype(float))
    return field


def spans_of(text: str, probability: np.ndarray) -> list[dict]:
    """Runs of toxic tokens as character offsets."""
    out: list[dict] = []
    if not (probability >= 0.5).any():
        return out
    previous = -2
    for i, found in enumerate(TOKEN.finditer(text)):
        if probability[i] >= 0.5:
            if previous == i - 1:
                out[-1] |= {"stop": found.end(), "probability": max(out[-1]["probability"], float(probability[i]))}
            else:
                out.append({"start": found.start(), "stop": found.end(), "probability": float(probability[i])})
            previous = i
    return out


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Field:
    return train(*labelled_sample(docs, labels, "toxic", per_class))


SPANS = "array<struct<start:long,stop:long,probability:double>>"


def scored(docs: DataFrame, field: Field) -> DataFrame:
    """``docs`` with ``toxic_score`` and ``toxic_spans``."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((field.weights, field.move, field.first, field.scale))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Field(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = texts_of(part)
                probabilities = model.probabilities([TOKEN.findall(t) for t in texts])
                spans = [spans_of(t, p) for t, p in zip(texts, probabilities)]
                kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("probability", pa.float64())]))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(model.scores(probabilities)), pa.array(spans, kind)],
                    [*part.schema.names, "toxic_score", "toxic_spans"],
                )

    columns = [c for c in docs.columns if c not in ("toxic_score", "toxic_spans")]
    docs = docs.select(*columns)
    schema = docs.withColumns({"toxic_score": F.lit(0.0), "toxic_spans": F.lit(None).cast(SPANS)}).schema
    return docs.mapInArrow(score, schema)


def without_toxic(docs: DataFrame, field: Field, threshold: float = 0.5) -> DataFrame:
    """``docs`` that score below the threshold, with their own columns."""
    columns, renamed = docs.columns, docs
    for name in ("toxic_score", "toxic_spans"):
        if name in columns:
            renamed = renamed.withColumnRenamed(name, f"_sievecraft_{name}")
    kept = scored(renamed, field).where(F.col("toxic_score") < threshold).drop("toxic_score", "toxic_spans")
    for name in ("toxic_score", "toxic_spans"):
        if name in columns:
            kept = kept.withColumnRenamed(f"_sievecraft_{name}", name)
    return kept.select(*columns)


def op2_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and number of toxic spans of every document."""
    docs = table(spark, sf_dir, "documents")
    field = fit(docs, table(spark, sf_dir, "labels"))
    return scored(docs.select("doc_id", "text"), field).select(
        "doc_id", held_out(F.col("doc_id"), 0).alias("held_out"), F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"), F.size("toxic_spans").alias("n_spans"),
        F.to_json("toxic_spans").alias("spans"),
    )
