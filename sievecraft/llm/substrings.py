"""Removal of long passages that an earlier document has, by suffix automata of reference shards.

A window of 50 words goes if a document with a smaller id has it too. Streaming every document through the automata of
all others would grow with the square of the corpus, so documents only meet the shards that can match:

1. Every window has an anchor: the smallest hash among its runs of ``ANCHOR`` words. Equal windows have equal anchors, and
   one anchor serves about 16 windows. Anchors that only one document has are dropped.
2. The first document of an anchor is its reference. Its passages under repeated anchors are one reference shard; the
   passages of later documents under the same anchors are routed to it. A shard asked by many words is copied, and its
   askers are spread over the copies.
3. Where they meet, the shard's suffix automaton is built over word numbers and the routed passages are streamed through
   it: the matching statistic is the length of the longest match that ends at each word, and 50 or more is a hit.
4. A window that its reference does not have (a passage in other surroundings) may still be in a third document: these
   few windows are compared by 128-bit fingerprints, least document first, counted before they are shuffled.
5. The words covered by windows found in either way are removed.

Defined results: null, empty and short texts lose nothing; rows without an id lose nothing and are no reference; rows that
share an id do not remove each other's words; windows are judged on the input; an empty table gives no rows; other
columns are kept as they are (``deduplicated``) or not read (the query).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecraft.llm.text import mixed, run_hashes, runs, table, texts_of, word_hashes
from sievecraft.scratch import staged
from sievecraft.shipping import ship

WINDOW, ANCHOR = 50, 20
#: Asking words for one copy of a shard, and words of a shard in one automaton.
ASKING, AUTOMATON = 100_000, 50_000


class SuffixAutomaton:
    """All runs of words of some passages: states with their longest length, suffix link and next states."""

    def __init__(self, passages: list[list[int]]) -> None:
        self.length, self.link, self.next = [0], [-1], [{}]
        last, between = 0, -2
        for passage in passages:
            for word in passage:
                last = self._add(last, word)
            last = self._add(last, between)  # no match runs from one passage into the next
            between -= 1

    def _add(self, last: int, word: int) -> int:
        length, link, following = self.length, self.link, self.next
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        following.append({})
        at = last
        while at >= 0 and word not in following[at]:
            following[at][word] = new
            at = link[at]
        if at >= 0:
            old = following[at][word]
            if length[old] == length[at] + 1:
                link[new] = old
            else:
                copy = len(length)
                length.append(length[at] + 1)
                link.append(link[old])
                following.append(dict(following[old]))
                while at >= 0 and following[at].get(word) == old:
                    following[at][word] = copy
                    at = link[at]
                link[old] = link[new] = copy
        return new

    def statistics(self, words: list[int]) -> np.ndarray:
        """The length of the longest match that ends at each word."""
        length, link, following = self.length, self.link, self.next
        state = matched = 0
        out = np.empty(len(words), np.int64)
        for i, word in enumerate(words):
            step = following[state].get(word)
            while step is None and state:
                state = link[state]
                matched = length[state]
                step = following[state].get(word)
            if step is None:
                matched = 0
            else:
                state, matched = step, matched + 1
            out[i] = matched
        return out


def anchors_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last window of each run of windows with one anchor."""
    if len(words) < WINDOW:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none
    grams = run_hashes(word_hashes(words), ANCHOR)
    width = WINDOW - ANCHOR + 1
    place = np.lib.stride_tricks.sliding_window_view(grams, width).argmin(axis=1)
    anchor = grams[np.arange(len(place)) + place]
    low = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    return anchor[low], low, np.append(low[1:], len(anchor)) - 1


def anchor_rows(docs: DataFrame) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out: list[list[np.ndarray]] = [[], [], [], []]
                for doc_id, text in zip(part.column(0).to_pylist(), texts_of(part)):
                    anchor, low, high = anchors_of(text.encode("utf-8", "replace").split())
                    for column, values in zip(out, (anchor.view(np.int64), np.full(len(low), doc_id), low, high)):
                        column.append(values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c).astype(np.int64)) for c in out], ["anchor", "doc", "low", "high"]
                )

    docs = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null and text is not null")
    return docs.mapInArrow(find, "anchor long, doc long, low long, high long")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of closed ranges of window starts; neighbours join."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def passages(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (shard, copy, asks, doc, text_key, low, text) of every passage that a document has under repeated anchors."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                out: list[list] = [[] for _ in range(7)]
                for doc, key, text, spans in zip(*(part.column(i).to_pylist() for i in range(4))):
                    words = text.encode("utf-8", "replace").split()
                    by_shard: dict[tuple[int, int], list] = {}
                    for s in spans:
                        by_shard.setdefault((s["first"], s["copies"]), []).append((s["low"], s["high"]))
                    for (shard, copies), own in by_shard.items():
                        for low, high in merged(own):
                            # rows that share an id get each other's ranges, which may lie beyond their end
                            if low + WINDOW > len(words):
                                continue
                            passage = b" ".join(words[low : high + WINDOW])
                            # askers are spread by a hash: ids may share a factor with the number of copies
                            own_copy = xxhash.xxh3_64_intdigest(b"%d %d" % (doc, low)) % copies
                            for copy in [own_copy] if doc != shard else range(copies):
                                for column, value in zip(out, (shard, copy, int(doc != shard), doc, key, low, passage)):
                                    column.append(value)
                kinds = [pa.int64()] * 6 + [pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(out, kinds)],
                    ["shard", "copy", "asks", "doc", "text_key", "low", "passage"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("text_key"), "text")
    return rows.where("text is not null").join(wanted, "doc").select("doc", "text_key", "text", "spans").mapInArrow(
        cut, "shard long, copy long, asks long, doc long, text_key long, low long, passage binary"
    )


def matched(rows: DataFrame) -> DataFrame:
    """doc, text_key, low, high of windows that the shard has; with f1 and f2 of those (low = high) that it has not."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, starts in runs(batches, ("shard", "copy")):
            out: list[list[np.ndarray]] = [[] for _ in range(6)]

            def put(doc: int, key: int, low: np.ndarray, high: np.ndarray, f1: np.ndarray, f2: np.ndarray) -> None:
                for column, v in zip(out, (np.full(len(low), doc), np.full(len(low), key), low, high, f1, f2)):
                    column.append(v)

            for start, stop in zip(starts, np.append(starts[1:], part.num_rows)):
                own = part.slice(start, stop - start).to_pylist()
                reference = [r["passage"] for r in own if not r["asks"]]
                asking = [r for r in own if r["asks"]]
                whole, hits = set(reference), {}
                hard = {r["passage"] for r in asking} - whole
                for shard in shards_of([p.split() for p in sorted(whole)]) if hard else ():
                    number: dict[bytes, int] = {}
                    automaton = SuffixAutomaton([[number.setdefault(w, len(number)) for w in p] for p in shard])
                    for passage in hard:
                        ids = [number.get(w, -1) for w in passage.split()]
                        hit = automaton.statistics(ids)[WINDOW - 1 :] >= WINDOW
                        hits[passage] = hits[passage] | hit if passage in hits else hit
                for row in asking:
                    passage, low = row["passage"], row["low"]
                    hit = hits.get(passage)
                    if hit is None:
                        hit = np.ones(len(passage.split()) - WINDOW + 1, bool)
                    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
                    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
                    zero = np.zeros(len(first), np.int64)
                    put(row["doc"], row["text_key"], low + first, low + last, zero, zero)
                    missed = np.flatnonzero(~hit)
                    if len(missed):
                        hashes = word_hashes(passage.split())
                        f1 = run_hashes(hashes, WINDOW)[missed].view(np.int64)
                        f2 = run_hashes(mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)), WINDOW)[missed].view(np.int64)
                        put(row["doc"], row["text_key"], low + missed, low + missed, f1, f2)
            columns = [np.concatenate(c) if c else np.empty(0, np.int64) for c in out]
            names = ["doc", "text_key", "low", "high", "f1", "f2"]
            yield from pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], names).to_batches()

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "shard", "copy").sortWithinPartitions("shard", "copy")
    return rows.mapInArrow(stream, "doc long, text_key long, low long, high long, f1 long, f2 long")


def shards_of(passages: list[list[bytes]]) -> Iterator[list[list[bytes]]]:
    """The passages in parts of at most ``AUTOMATON`` words; longer ones are cut with an overlap of a window less a word."""
    part, size = [], 0
    for passage in passages:
        for at in range(0, max(len(passage) - WINDOW + 1, 1), AUTOMATON - WINDOW + 1):
            piece = passage[at : at + AUTOMATON]
            if part and size + len(piece) > AUTOMATON:
                yield part
                part, size = [], 0
            part.append(piece)
            size += len(piece)
    if part:
        yield part


def removals(docs: DataFrame) -> DataFrame:
    """doc, text_key and the ranges of window starts to remove, for documents that lose words."""
    ship(docs.sparkSession)
    anchors = staged(anchor_rows(docs), "anchors")
    repeated = anchors.groupBy("anchor").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    repeated = staged(repeated.where("first < last").drop("last"), "repeated-anchors")
    uses = staged(anchors.join(repeated, "anchor").drop("anchor"), "anchor-uses")
    asked = uses.where("doc > first").groupBy("first").agg(F.sum(F.col("high") - F.col("low") + WINDOW).alias("words"))
    asked = staged(asked.select("first", F.ceil(F.col("words") / ASKING).alias("copies")), "shard-copies")
    wanted = uses.join(asked, "first").groupBy("doc").agg(
        F.collect_list(F.struct("first", "copies", "low", "high")).alias("spans")
    )
    found = staged(matched(passages(docs, wanted)), "matches")
    missed = found.where("f1 <> 0 or f2 <> 0")
    third = missed.groupBy("f1", "f2").agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
    third = staged(third.where("least < most").drop("most"), "third-matches")
    late = missed.join(third, ["f1", "f2"]).where("doc > least").select("doc", "text_key", "low", "high")
    hits = found.where("f1 = 0 and f2 = 0").select("doc", "text_key", "low", "high").unionByName(late)
    return hits.groupBy("doc", "text_key").agg(F.collect_list(F.struct("low", "high")).alias("spans"))


def kept_words(text: str, spans: list[dict] | None) -> tuple[list[bytes], int]:
    """The words that stay, and how many there were."""
    words = text.encode("utf-8", "replace").split()
    if not spans:
        return words, len(words)
    out, at = [], 0
    for low, high in merged([(s["low"], s["high"] + WINDOW - 1) for s in spans]):
        out += words[at:low]
        at = high + 1
    return out + words[at:], len(words)


def with_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_sievecraft_spans``, null where nothing goes."""
    spans = removals(docs.select("doc_id", "text")).select(
        F.col("doc").alias("_sievecraft_doc"), F.col("text_key").alias("_sievecraft_key"), F.col("spans").alias("_sievecraft_spans")
    )
    docs = docs.withColumn("_sievecraft_text_key", F.xxhash64("text"))
    on = (docs["doc_id"].cast("long") == spans["_sievecraft_doc"]) & (docs["_sievecraft_text_key"] == spans["_sievecraft_key"])
    return docs.join(spans, on, "left").drop("_sievecraft_doc", "_sievecraft_key", "_sievecraft_text_key")


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` without the words that an earlier document has in a passage of 50 or more.

    Texts that lose nothing stay as they are; the words left of others are joined by one space.
    """
    columns = docs.columns

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column("text").to_pylist(), batch.column("_sievecraft_spans").to_pylist()
            new = [b" ".join(kept_words(t, s)[0]).decode("utf-8", "replace") if s else t for t, s in zip(texts, spans)]
            arrays = [pa.array(new, pa.string()) if c == "text" else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, columns)

    return with_spans(docs).mapInArrow(rewrite, docs.schema)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, words removed and a digest of those kept, for every document."""
    docs = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, sums = [], [], []
            for text, spans in zip(texts_of(batch), batch.column("_sievecraft_spans").to_pylist()):
                kept, n = kept_words(text, spans)
                sizes.append(n)
                removed.append(n - len(kept))
                sums.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(sums, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text", "_sievecraft_spans").mapInArrow(
        digest, "doc_id long, n_words long, n_removed long, kept_sha256 string"
    )
