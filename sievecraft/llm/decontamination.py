"""Benchmark decontamination: a BM25 inverted index of the test items, asked by every passage of every document.

The items are the indexed side. A posting's impact is its BM25 weight divided by the score the item gives itself, so a
passage that holds all of an item's words scores 1, and one threshold serves items of every length. Postings are in item
order, in blocks with their largest impact; block-max WAND finds every item above the threshold without scoring the rest.

A passage is a window of a document's words; windows overlap by more than the longest item, so that each occurrence of an
item lies in one window as a whole. A window whose words' largest impacts do not add up to the threshold cannot hold an
answer and is skipped by a running sum. What is found is verified on the words themselves: the shares of the item's
five-word shingles, of its question and of its answer (its last sentence), that the document has. A document is
contaminated by an item if it has 0.8 of all shingles, or 0.8 of the question's and half of the answer's.

An index holds at most ``ITEMS`` items and ``LETTERS`` of text, which bounds what is broadcast; more items make more indexes,
asked one after the other: what one finds is written before the next is sent.

Defined results: null and empty texts match nothing; an item without words cannot be found; an item of fewer than five
words is one shingle; equal items are found each; rows with null or repeated ids are asked each, and matches are reported
once for each id and item; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecraft.llm.text import lower_ascii, table, texts_of
from sievecraft.scratch import staged
from sievecraft.shipping import ship

LETTERS = 20_000_000
ITEMS, BLOCK, K1, B, REMEMBERED, AT_ONCE = 20_000, 4, 1.2, 0.75, 400_000, 64
THRESHOLD, SHARE, ANSWER_SHARE, SHINGLE = 0.6, 0.8, 0.5, 5
MARKS = b"\"'.,;:!?()[]{}<>*#|"
SENTENCE = re.compile(r"(?<=[.!?])\s+")


def terms_of(text: str) -> list[bytes]:
    """Lower-case words without outer marks."""
    words = (w.strip(MARKS) for w in lower_ascii(text).split())
    return [w for w in words if w]


def shingles(words: list[bytes]) -> set[tuple[bytes, ...]]:
    k = min(SHINGLE, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def question_and_answer(text: str) -> tuple[str, str]:
    """The last sentence is the answer; a single sentence is question and answer."""
    sentences = [s for s in SENTENCE.split(text.strip()) if s]
    return (" ".join(sentences[:-1]), sentences[-1]) if len(sentences) > 1 else (text, text)


def ranges(starts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """All places from ``starts[r]`` to ``starts[r + 1]`` for each row."""
    first, size = starts[rows], starts[rows + 1] - starts[rows]
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - first, size)


@dataclass
class Item:
    item_id: int
    whole: set
    question: set
    answer: set


class Index:
    """Postings in item order, in blocks with their largest impact."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        words = [terms_of(text) for _, text in items]
        self.items = []
        for (item_id, text), own in zip(items, words):
            question, answer = question_and_answer(text)
            self.items.append(Item(item_id, shingles(own), shingles(terms_of(question)), shingles(terms_of(answer))))
        self.longest = max(map(len, words), default=0)
        counts = [Counter(w) for w in words]
        found_in = Counter(t for c in counts for t in c)
        mean = sum(map(len, words)) / max(len(words), 1)
        postings: dict[bytes, list[tuple[int, float]]] = {t: [] for t in found_in}
        for number, (count, own) in enumerate(zip(counts, words)):
            norm = K1 * (1 - B + B * len(own) / mean) if mean else 0.0
            weights = {
                t: float(np.log1p((len(items) - found_in[t] + 0.5) / (found_in[t] + 0.5)) * n * (K1 + 1) / (n + norm))
                for t, n in count.items()
            }
            total = sum(weights.values())
            for t, w in weights.items():
                postings[t].append((number, w / total))
        self.terms = {t: i for i, t in enumerate(postings)}
        self.most = np.array([max(w for _, w in p) for p in postings.values()] + [0.0])
        term = np.repeat(np.arange(len(postings)), [len(p) for p in postings.values()])
        self.item = np.array([n for p in postings.values() for n, _ in p], np.int64)
        self.impact = np.array([w for p in postings.values() for _, w in p])
        # a block is the part of a term's postings that lies in one range of items
        key = term * (len(items) // BLOCK + 1) + self.item // BLOCK
        first = np.flatnonzero(np.diff(key, prepend=-1))
        self.postings_at = np.append(first, len(key))
        self.block = self.item[first] // BLOCK if len(key) else np.empty(0, np.int64)
        self.block_most = np.maximum.reduceat(self.impact, first) if len(key) else np.empty(0)
        self.blocks_at = np.searchsorted(term[first] if len(key) else np.empty(0, np.int64), np.arange(len(postings) + 1))
        self._known: dict[bytes, int] = {}

    def ids_of(self, text: str) -> np.ndarray:
        """Term numbers of a text's words; words outside the index have the number after the last."""
        known, terms, absent = self._known, self.terms, len(self.terms)
        if len(known) > REMEMBERED:
            known.clear()
        out = []
        for word in lower_ascii(text).split():
            number = known.get(word)
            if number is None:
                bare = word.strip(MARKS)
                number = known[word] = terms.get(bare, absent) if bare else -1
            if number >= 0:
                out.append(number)
        return np.array(out, dtype=np.int64)

    def search(self, passages: np.ndarray, terms: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Items and scores of at least ``threshold``, for passages given as pairs of passage and distinct term.

        Block-max WAND with a range of items as the step: the sum of the terms' block maxima bounds every item of the
        range, ranges below the threshold are skipped whole, and only the others' postings are added up.
        """
        slack, items = threshold - 1e-9, len(self.items)
        entries = ranges(self.blocks_at, terms)
        owner = np.repeat(passages, self.blocks_at[terms + 1] - self.blocks_at[terms])
        key = owner * (items // BLOCK + 1) + self.block[entries]
        alive = np.bincount(key, self.block_most[entries], minlength=1)[key] >= slack
        entries, owner = entries[alive], owner[alive]
        at = ranges(self.postings_at, entries)
        key = np.repeat(owner, self.postings_at[entries + 1] - self.postings_at[entries]) * items + self.item[at]
        score = np.bincount(key, self.impact[at], minlength=1)
        found = np.flatnonzero(score >= slack)
        return found % items, score[found]

    def matches(self, text: str, threshold: float) -> dict[int, float]:
        """Best BM25 share of each item found in any passage."""
        ids = self.ids_of(text)
        if not len(ids) or not self.terms:
            return {}
        stride = self.longest + 1
        order = np.argsort(ids, kind="stable")
        before = np.full(len(ids), -1)
        same = ids[order[1:]] == ids[order[:-1]]
        before[order[1:][same]] = order[:-1][same]
        place = np.arange(len(ids))
        window = place // stride
        # a word counts once for a passage: where it has not been in it before; passages are 2 * stride - 1 words
        here = before < window * stride
        late = (window > 0) & (place % stride < stride - 1) & (before < (window - 1) * stride)
        passage = np.concatenate([window[here], window[late] - 1])
        term = np.concatenate([ids[here], ids[late]])
        known = term < len(self.terms)
        passage, term = passage[known], term[known]
        hopeful = np.bincount(passage, self.most[term], minlength=window[-1] + 1) >= threshold - 1e-9
        best: dict[int, float] = {}
        for first in range(0, len(hopeful), AT_ONCE):
            part = hopeful[passage] & (passage >= first) & (passage < first + AT_ONCE)
            if part.any():
                for item, score in zip(*self.search(passage[part] - first, term[part], threshold)):
                    best[int(item)] = max(best.get(int(item), 0.0), float(score))
        return best

    def verified(self, text: str, threshold: float) -> list[tuple[int, float, float, float, float]]:
        """(item_id, bm25, overlap, question_overlap, answer_overlap) of each item that contaminates the text."""
        best = self.matches(text, threshold)
        if not best:
            return []
        words = terms_of(text)
        own = {k: {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} for k in range(1, SHINGLE + 1)} if any(
            len(next(iter(s), ())) < SHINGLE for n in best for s in (self.items[n].whole, self.items[n].question, self.items[n].answer)
        ) else {SHINGLE: {tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}}

        def share(wanted: set) -> float:
            return sum(s in own.get(len(s), ()) for s in wanted) / len(wanted) if wanted else 0.0

        out = []
        for number, score in sorted(best.items()):
            item = self.items[number]
            overlap, question, answer = share(item.whole), share(item.question), share(item.answer)
            if overlap >= SHARE or (question >= SHARE and answer >= ANSWER_SHARE):
                out.append((item.item_id, score, overlap, question, answer))
        return out


MATCHES = "array<struct<item_id:long,bm25:double,overlap:double,question_overlap:double,answer_overlap:double>>"
KIND = pa.list_(pa.struct([("item_id", pa.int64()), *((n, pa.float64()) for n in ("bm25", "overlap", "question_overlap", "answer_overlap"))]))


def indexes(benchmark: DataFrame, items: int = ITEMS, letters: int = LETTERS) -> Iterator[Index]:
    """Indexes of at most ``items`` items and ``letters`` of text each (or one item), by ranges of their order.

    Only one is held at a time, here and by those who stage what they find before they go on.
    """
    rows = benchmark.where("text is not null").select(F.col("item_id").cast("long"), "text").orderBy("item_id", "text")
    part: list[tuple[int, str]] = []
    size = 0
    for row in rows.toLocalIterator():
        if part and (len(part) == items or size + len(row["text"]) > letters):
            yield Index(part)
            part, size = [], 0
        part.append((row["item_id"], row["text"]))
        size += len(row["text"])
    if part:
        yield Index(part)


def with_matches(
    docs: DataFrame, index: Index, threshold: float = THRESHOLD, column: str = "contaminated_by", sent: list | None = None
) -> DataFrame:
    """``docs`` with what contaminates them; what the index is broadcast as is added to ``sent``."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast([(i.item_id, i.whole, i.question, i.answer) for i in index.items])
    rest = docs.sparkSession.sparkContext.broadcast({k: v for k, v in vars(index).items() if k != "items"})
    if sent is not None:
        sent += [shared, rest]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Index.__new__(Index)
        vars(own).update(rest.value, items=[Item(*i) for i in shared.value])
        for batch in batches:
            fields = ("item_id", "bm25", "overlap", "question_overlap", "answer_overlap")
            found = [[dict(zip(fields, m)) for m in own.verified(t, threshold)] for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, KIND)], [*batch.schema.names, column])

    docs = docs.select(*[c for c in docs.columns if c != column])
    return docs.mapInArrow(ask, docs.withColumn(column, F.lit(None).cast(MATCHES)).schema)


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and item of every verified match."""
    parts = []
    for index in indexes(benchmark):
        sent: list = []
        found = with_matches(docs.select("doc_id", "text"), index, threshold, sent=sent).where(F.size("contaminated_by") > 0)
        parts.append(staged(found.select("doc_id", F.explode("contaminated_by").alias("m")).select("doc_id", "m.*"), "matches"))
        for part in sent:
            part.destroy()
    if not parts:
        return docs.limit(0).select(F.col("doc_id"), F.explode(F.lit(None).cast(MATCHES)).alias("m")).select("doc_id", "m.*")
    both = reduce(DataFrame.unionByName, parts)
    values = ("bm25", "overlap", "question_overlap", "answer_overlap")
    return both.groupBy("doc_id", "item_id").agg(*[F.max(v).alias(v) for v in values])


def decontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that hold an item; written once for each index but the last."""
    column = "_sievecraft_matches"
    sent: list = []
    for index in indexes(benchmark):
        if sent:
            docs = staged(docs, "clean")
            while sent:
                sent.pop().destroy()
        docs = with_matches(docs, index, threshold, column, sent).where(F.size(column) == 0).drop(column)
    return docs


def op9_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every contaminated document with the item that it holds."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
