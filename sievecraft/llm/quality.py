"""Quality scores by positive-unlabelled learning.

Trusted positives are documents labelled good; the unlabelled set is web text as it comes, good and bad mixed. A linear
scorer of text statistics and byte frequencies (and their squares) minimises the non-negative unbiased risk

    prior * R_positive(+) + max(0, R_unlabelled(-) - prior * R_positive(-))

with the logistic loss, so that its sigmoid estimates the probability of being good. Where the second part falls below 0,
a step is taken against it, which keeps it from overfitting. The class prior is estimated: for every region, the share of
unlabelled texts in it divided by the share of positives in it bounds the prior from above, and the least such bound over
the upper tails of a first scorer is taken. The shares of unlabelled texts are counted over all documents that are not held
out.

The weights are fitted on bounded samples of both sets (``POSITIVES``, ``UNLABELLED``); the prior, statistics, scores and
the result cover all rows and whole texts.

Defined results: null and empty texts have the statistics of an empty text and one and the same score; equal texts get
equal scores; without trusted positives every score is 0.5; a document labelled both ways counts as a positive; null and
repeated ids are scored each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecraft.llm.text import held_out, table, texts_of
from sievecraft.shipping import ship

#: Trusted positives and unlabelled texts that training takes at most.
POSITIVES, UNLABELLED = 4000, 8000
N_STATISTICS, BYTES = 18, 256


def statistics(text: str) -> np.ndarray:
    data = text.encode("utf-8", "replace")
    out = np.zeros(N_STATISTICS + BYTES, dtype=np.float32)
    if not data:
        return out
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=BYTES)
    n = len(data)
    words, lines = data.split(), data.split(b"\n")
    n_words, n_lines = max(len(words), 1), len(lines)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1)
    letters = counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()
    digits, spaces = counts[48:58].sum(), counts[32] + counts[9:14].sum()
    again = sum(map(bytes.__eq__, words, words[1:]))
    marks = n - letters - digits - spaces
    ends = counts[33] + counts[46] + counts[63]
    out[:N_STATISTICS] = (
        np.log1p(len(words)), np.log1p(n), lengths.mean() / 10, lengths.std() / 10, counts[65:91].sum() / n,
        digits / n, marks / n, len(set(words)) / n_words, n_lines / n_words,
        len(set(lines)) / n_lines, ends / n_words, counts[44] / n_words, (lengths > 20).mean(), (lengths <= 3).mean(),
        again / n_words, (lengths == 1).mean(), marks / n_words, np.log1p(again),
    )
    out[N_STATISTICS:] = np.sqrt(counts / n)
    return out


def with_squares(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, x * x], axis=1)


@dataclass
class Scorer:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        scaled = np.clip((with_squares(x) - self.mean) / self.spread, -6, 6)
        return scaled @ self.weights + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def minimise(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 300, rate: float = 0.02):
    """Weights and bias of least non-negative risk, by Adam over all rows."""
    width = positive.shape[1]
    w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    p1 = np.concatenate([positive, np.ones((len(positive), 1))], axis=1)
    u1 = np.concatenate([unlabelled, np.ones((len(unlabelled), 1))], axis=1)
    for k in range(1, rounds + 1):
        gp, gu = p1 @ w, u1 @ w
        sp, su = sigmoid(gp), sigmoid(gu)
        plus = -prior * (p1.T @ (1 - sp)) / len(p1)
        minus = (u1.T @ su) / len(u1) - prior * (p1.T @ sp) / len(p1)
        negative_risk = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        slope = plus + minus if negative_risk >= 0 else -minus
        slope = slope + 1e-4 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        w = w - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w[:-1], float(w[-1])


#: Shares of the positives in the tails that are looked at.
TAILS = np.linspace(0.2, 1.0, 41)


def tail_cuts(positive: np.ndarray) -> np.ndarray:
    """Margins above which these shares of the positives lie."""
    return np.quantile(positive, 1 - TAILS)


def estimated_prior(positive: np.ndarray, above: np.ndarray, unlabelled: int) -> float:
    """Least upper bound over tails that hold a fifth of the positives or more; one standard error is added.

    ``above``: how many of the unlabelled reach each of ``tail_cuts``.
    """
    best = 1.0
    for cut, n in zip(tail_cuts(positive), above):
        p, u = (positive >= cut).mean(), n / unlabelled
        error = np.sqrt(u * (1 - u) / unlabelled + p * (1 - p) / len(positive))
        best = min(best, (u + error) / max(p, 1e-9))
    return float(np.clip(best, 0.01, 0.99))


def reaching(margins: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return (margins[:, None] >= cuts).sum(axis=0)


def train(positive: np.ndarray, unlabelled: np.ndarray, counted=None) -> Scorer:
    """A scorer from statistics of trusted and of unlabelled texts.

    ``counted`` takes a first scorer and margins, and tells how many of all unlabelled texts reach each, and how many there
    are; without it the second half of ``unlabelled`` stands for them.
    """
    width = 2 * (N_STATISTICS + BYTES)
    if not len(positive) or not len(unlabelled):
        return Scorer(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 0.5)
    p, u = with_squares(positive.astype(np.float64)), with_squares(unlabelled.astype(np.float64))
    both = np.concatenate([p, u])
    mean, spread = both.mean(axis=0), both.std(axis=0) + 1e-3
    p, u = np.clip((p - mean) / spread, -6, 6), np.clip((u - mean) / spread, -6, 6)
    prior = 0.5
    if len(p) > 1 and len(u) > 1:
        # a first scorer from one half tells positives from unlabelled; the other half bounds the prior
        w, b = minimise(p[::2], u[::2], 0.5, rounds=150)
        margins = p[1::2] @ w + b
        cuts = tail_cuts(margins)
        if counted is None:
            above, n = reaching(u[1::2] @ w + b, cuts), len(u[1::2])
        else:
            above, n = counted(Scorer(mean, spread, w, b, 0.5), cuts)
        prior = estimated_prior(margins, above, n)
    w, b = minimise(p, u, prior)
    return Scorer(mean, spread, w, b, prior)


def featured(docs: DataFrame) -> DataFrame:
    """doc_id and its statistics."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(rows, pa.list_(pa.float32()))], ["doc_id", "statistics"]
            )

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(compute, "doc_id long, statistics array<float>")


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Scorer:
    """Learns from the labels and texts of rows that are not held out."""
    known = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 0)
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    trusted = labels.where(known & (F.col("quality") == 1)).select("doc_id").distinct().orderBy(*order).limit(positives)
    taken = docs.where(known).select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit("u")), "doc_id")
    chosen = trusted.withColumn("role", F.lit(1)).unionByName(taken.limit(unlabelled).withColumn("role", F.lit(0)))
    # the ids are bounded by the two parameters, and so is what comes back
    roles = chosen.groupBy("doc_id").agg(F.max("role").alias("trusted"), F.min("role").alias("all_trusted"))
    found = docs.select("doc_id", "text").join(F.broadcast(roles), "doc_id")
    rows = featured(found.groupBy("doc_id").agg(F.min("text").alias("text"))).toPandas()
    kinds = roles.toPandas().set_index("doc_id")
    if not len(rows):
        return train(np.empty((0, N_STATISTICS + BYTES)), np.empty((0, N_STATISTICS + BYTES)))
    rows = rows.sort_values("doc_id").set_index("doc_id").join(kinds)
    x = np.stack(rows["statistics"].to_numpy())
    everything = docs.where(known).select("doc_id", "text")
    return train(
        x[rows["trusted"].to_numpy() == 1], x[rows["all_trusted"].to_numpy() == 0], lambda s, cuts: count_above(everything, s, cuts)
    )


def count_above(docs: DataFrame, scorer: Scorer, cuts: np.ndarray) -> tuple[np.ndarray, int]:
    """How many of the texts have a margin of at least each cut, and how many there are. One row of counts for each batch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.stack([statistics(t) for t in texts_of(batch)]).astype(np.float64)
                row = [*reaching(shared.value.margin(x), cuts).tolist(), batch.num_rows]
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()) for n in row], names)

    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    names = [f"n{i}" for i in range(len(cuts) + 1)]
    counts = docs.mapInArrow(count, ", ".join(f"{n} long" for n in names)).agg(*[F.coalesce(F.sum(n), F.lit(0)) for n in names])
    *above, n = counts.first()
    return np.array(above), max(int(n), 1)


def scored(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """``docs`` with ``quality_score``."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.stack([statistics(t) for t in texts_of(batch)]).astype(np.float64)
                values = pa.array(shared.value.score(x))
                yield pa.RecordBatch.from_arrays([*batch.columns, values], [*batch.schema.names, "quality_score"])

    docs = docs.select(*[c for c in docs.columns if c != "quality_score"])
    return docs.mapInArrow(score, docs.withColumn("quality_score", F.lit(0.0)).schema)


def op10_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs = table(spark, sf_dir, "documents")
    scorer = fit(docs, table(spark, sf_dir, "labels"))
    return scored(docs.select("doc_id", "text"), scorer).select(
        "doc_id", held_out(F.col("doc_id"), 0).alias("held_out"), F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.3).cast("int").alias("predicted"),
    )
