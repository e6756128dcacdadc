"""Removal of byte strings that occur more than once, by suffix arrays of what can repeat.

A byte goes if a 200-byte string that covers it also starts anywhere else, in this document or another.

1. Equal texts are folded into one with a count.
2. Every window of 200 bytes has an anchor: the smallest hash among its 48-byte strings. Equal windows have equal anchors,
   and one anchor serves some 77 windows. Anchors that occur once anywhere are dropped.
3. An anchor's home is the text of least hash that has it. Windows go to their anchor's home, neighbouring windows with one
   home as one passage. Equal passages are counted before they meet; two of each are enough, as a third finds nothing new.
   A home with more than ``HOME_BYTES`` is dealt by passage into parts.
4. Where passages meet, a suffix array is built over them by two-stage sorting (``suffix_array``), and windows whose common
   prefix with a neighbour in it has 200 bytes or more are repeated.
5. Windows of a home in several parts may have their equal in another part: each part sends a 128-bit fingerprint of every
   distinct window, dealt by fingerprint and packed, which are counted; these few homes hold the only windows that are
   compared that way.
6. Spans of repeated windows go back to the texts, whose bytes they cover are removed.

Defined results: a null text is empty; texts below 200 bytes lose nothing; rows without an id, or that share one, are
documents of their own; equal rows are copies of each other; windows are judged on the input; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecraft.llm.suffix_array import Passages, common_prefixes, suffix_array
from sievecraft.llm.text import mixed, runs, table
from sievecraft.scratch import staged
from sievecraft.shipping import ship

#: Bytes of a window, bytes that an anchor is made of.
WINDOW, GRAM = 200, 48
#: Bytes of a home before it is dealt into parts, of one suffix array (a whole home or part at least), and of texts hashed
#: at a time.
HOME_BYTES, ARRAY_BYTES, HASHED = 2_000_000, 1_000_000, 1 << 21
#: Windows of homes in several parts that one task counts at a time.
SLOT_WINDOWS = 200_000
#: Bits for a place in what is hashed at a time, with a text cut from HASHED bytes on.
PLACE_BITS = 23
MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def string_hashes(data: bytes, size: int, multiplier: np.uint64 = MULTIPLIERS[0]) -> np.ndarray:
    """The hash of the ``size`` bytes (8 or more) from each place on, by doubling; empty if there are fewer."""
    n = len(data) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    whole = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    out, width = mixed(whole * multiplier), 8
    while 2 * width <= size:
        out = mixed(out[:-width] * multiplier + out[width:])
        width *= 2
    if width < size:
        # what is missing overlaps what is there
        rest = size - width
        out = mixed(out[: len(out) - rest] * multiplier + out[rest:])
    return out


def least_of(values: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` values in a row."""
    width = 1
    while 2 * width <= size:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    return np.minimum(values[: len(values) - (size - width)], values[size - width :]) if width < size else values


def anchors_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: text, anchor, first and last window, at how many places the anchor is."""
    data = b"".join(texts)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes) - sizes
    grams = string_hashes(data, GRAM)
    if len(data) < WINDOW:
        none = np.empty(0, np.int64)
        return none, none.astype(np.uint64), none, none, none
    mask = np.uint64((1 << PLACE_BITS) - 1)
    key = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
    place = (least_of(key, WINDOW - GRAM + 1) & mask).astype(np.int64)
    windows = np.maximum(sizes - WINDOW + 1, 0)
    text = np.repeat(np.arange(len(texts)), windows)
    at = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows - starts, windows)
    place = place[at]
    anchor = grams[place]
    moved = np.concatenate([[True], (place[1:] != place[:-1])])
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    low = np.flatnonzero(new)
    high = np.append(low[1:], len(new)) - 1
    if not len(text):
        low = high = np.empty(0, np.int64)
    places = np.add.reduceat((moved | new).astype(np.int64), low) if len(low) else low
    first = starts[text[low]]
    return text[low], anchor[low], at[low] - first, at[high] - first, places


def anchor_rows(texts: DataFrame) -> DataFrame:
    """Rows (anchor, k1, k2, low, high, places) of every text; ``places`` counts a second copy of the text too."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            size = 0
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for k1, k2, text, copies in zip(*(part.column(i).to_pylist() for i in range(4))):
                    data = text.encode("utf-8", "replace")
                    # stretches that share all but one byte of a window hold every window once
                    for low in range(0, max(len(data) - WINDOW + 1, 1), HASHED):
                        held.append((k1, k2, low, data[low : low + HASHED + WINDOW - 1], min(copies, 2)))
                        size += len(held[-1][3])
                        if size >= HASHED:
                            yield rows(held)
                            held, size = [], 0
            if held:
                yield rows(held)

    def rows(held: list[tuple]) -> pa.RecordBatch:
        text, anchor, low, high, places = anchors_of([h[3] for h in held])
        k1, k2, begin, copies = (np.array([h[i] for h in held], np.int64)[text] for i in (0, 1, 2, 4))
        columns = [anchor.view(np.int64), k1, k2, low + begin, high + begin, places * copies]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor", "k1", "k2", "low", "high", "places"])

    return texts.select("k1", "k2", "text", "copies").mapInArrow(
        find, "anchor long, k1 long, k2 long, low long, high long, places long"
    )


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of closed ranges; neighbours join."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1] + 1:
            if high > out[-1][1]:
                out[-1] = (out[-1][0], high)
        else:
            out.append((low, high))
    return out


def passages(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (home, part, parts, d1, d2, k1, k2, low, copies, passage) of the stretches that anchors send to each home.

    Within a batch a passage travels once; its other rows have none.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: list[list] = [[] for _ in range(10)]
                seen: set = set()
                for k1, k2, copies, text, spans in zip(*(part.column(i).to_pylist() for i in range(5))):
                    data = text.encode("utf-8", "replace")
                    homes: dict[tuple[int, int], list] = {}
                    for s in spans:
                        homes.setdefault((s["home"], s["parts"]), []).append((s["low"], s["high"]))
                    for (home, parts), own in homes.items():
                        for low, high in merged(own):
                            passage = data[low : high + WINDOW]
                            digest = xxhash.xxh3_128_digest(passage)
                            d1, d2 = int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)
                            row = (home, d1 % parts, parts, d1, d2, k1, k2, low, copies, None if digest in seen else passage)
                            seen.add(digest)
                            for column, value in zip(out, row):
                                column.append(value)
                kinds = [pa.int64()] * 9 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    names = ["home", "part", "parts", "d1", "d2", "k1", "k2", "low", "copies", "passage"]
    rows = texts.join(wanted, ["k1", "k2"]).select("k1", "k2", "copies", "text", "spans")
    return rows.mapInArrow(
        cut, ", ".join(f"{n} {'binary' if n == 'passage' else 'long'}" for n in names)
    )


def repeated(rows: DataFrame, slots: int) -> DataFrame:
    """Repeated windows of passages (home, part, parts, d1, d2, copies, passage).

    Rows (d1, d2, low, high) are ranges of windows that are repeated within a home's part. Rows (slot, entries) hold the
    distinct windows of parts of a home, dealt by fingerprint: (f1, f2, n, d1, d2, low) as 64-bit numbers, ``n`` being 1 and
    the rest the window's place where it occurs once in the part, else 2.
    """

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bool, bytes]] = []
        size = 0
        for part, starts in runs(batches, ("home", "part")):
            for start, stop in zip(starts, np.append(starts[1:], part.num_rows)):
                own = part.slice(start, stop - start)
                for parts, d1, d2, copies, passage in zip(*(own.column(c).to_pylist() for c in ("parts", "d1", "d2", "copies", "passage"))):
                    # a second copy, if there is one, and no more
                    for _ in range(min(copies, 2)):
                        held.append((d1, d2, parts > 1, passage))
                        size += len(passage)
                if size >= ARRAY_BYTES:
                    yield from found(held)
                    held, size = [], 0
        if held:
            yield from found(held)

    def found(held: list[tuple[int, int, bool, bytes]]) -> Iterator[pa.RecordBatch]:
        text = Passages([h[3] for h in held])
        order = suffix_array(text)
        before, length = common_prefixes(text, order)
        hit = length >= WINDOW
        again = hit.copy()
        again[before[hit]] = True
        owner = np.repeat(np.arange(len(held)), text.separators - text.starts + 1)
        d1, d2 = (np.array([h[i] for h in held], np.int64) for i in (0, 1))
        edge = np.diff(again.astype(np.int8), prepend=0, append=0)
        low, high = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
        at = owner[low]
        begin = text.starts[at]
        yield batch(len(low), d1=d1[at], d2=d2[at], low=low - begin, high=high - begin)
        split = np.array([h[2] for h in held], bool)[owner] & (text.left() >= WINDOW)
        if split.any():
            # the first of each stretch of equal windows in the order stands for them
            ranked = order[split[order]]
            places = np.sort(ranked[~hit[ranked]])
            f1, f2 = (string_hashes(text.data, WINDOW, m)[places].view(np.int64) for m in MULTIPLIERS)
            at = owner[places]
            entries = np.stack([f1, f2, np.where(again[places], 2, 1), d1[at], d2[at], places - text.starts[at]], axis=1)
            slot = (f1.view(np.uint64) % np.uint64(slots)).astype(np.int64)
            dealt = np.argsort(slot, kind="stable")
            entries, slot = entries[dealt].astype("<i8"), slot[dealt]
            first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
            blobs = [entries[a:b].tobytes() for a, b in zip(first, np.append(first[1:], len(slot)))]
            yield batch(len(first), slot=slot[first], entries=blobs)

    def batch(n: int, **columns) -> pa.RecordBatch:
        arrays = [
            pa.array(columns[c], pa.binary() if c == "entries" else pa.int64()) if c in columns
            else pa.nulls(n, pa.binary() if c == "entries" else pa.int64())
            for c in names
        ]
        return pa.RecordBatch.from_arrays(arrays, names)

    names = ["d1", "d2", "low", "high", "slot", "entries"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "home", "part").sortWithinPartitions("home", "part")
    return dealt.mapInArrow(sort, "d1 long, d2 long, low long, high long, slot long, entries binary")


def repeated_across(rows: DataFrame) -> DataFrame:
    """(d1, d2, low, high) of windows that occur once in a part of their home and again in another part."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, starts in runs(batches, ("slot",)):
            blobs = part.column("entries").to_pylist()
            for start, stop in zip(starts, np.append(starts[1:], part.num_rows)):
                entries = np.frombuffer(b"".join(blobs[start:stop]), "<i8").reshape(-1, 6)
                entries = entries[np.lexsort((entries[:, 1], entries[:, 0]))]
                new = np.concatenate([[True], (entries[1:, :2] != entries[:-1, :2]).any(axis=1)])
                total = np.add.reduceat(entries[:, 2], np.flatnonzero(new))[np.cumsum(new) - 1]
                d1, d2, low = entries[(total > 1) & (entries[:, 2] == 1)][:, 3:].T
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (d1, d2, low, low)], ["d1", "d2", "low", "high"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "slot").sortWithinPartitions("slot")
    return dealt.mapInArrow(count, "d1 long, d2 long, low long, high long")


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(k1, k2, spans): ranges of repeated windows of each text that has any.

    ``texts`` (k1, k2, text, copies) has every distinct text once and must be stored, as it is read twice.
    """
    long = texts.where(F.octet_length("text") >= WINDOW)
    anchors = staged(anchor_rows(long), "byte-anchors")
    counts = anchors.groupBy("anchor").agg(F.sum("places").alias("total"), F.min("k1").alias("home"))
    shared = staged(counts.where("total > 1").drop("total"), "repeated-byte-anchors")
    uses = staged(anchors.join(shared, "anchor").select("k1", "k2", "home", "low", "high"), "byte-anchor-uses")
    parts = uses.groupBy("home").agg(F.ceil(F.sum(F.col("high") - F.col("low") + WINDOW) / HOME_BYTES).alias("parts"))
    parts = staged(parts, "home-parts")
    split = int(parts.where("parts > 1").agg(F.sum("parts")).first()[0] or 0)
    wanted = uses.join(parts, "home").groupBy("k1", "k2").agg(
        F.collect_list(F.struct("home", "parts", "low", "high")).alias("spans")
    )
    rows = staged(passages(long, wanted), "passages")
    name = ["home", "part", "parts", "d1", "d2"]
    distinct = rows.groupBy(*name).agg(F.sum("copies").alias("copies"), F.any_value("passage", True).alias("passage"))
    found = staged(repeated(distinct, max(1, split * HOME_BYTES // SLOT_WINDOWS)), "repeated-windows")
    marks = found.where("slot is null").select("d1", "d2", "low", "high")
    marks = marks.unionByName(repeated_across(found.where("slot is not null").select("slot", "entries")))
    marks = marks.withColumnsRenamed({"low": "from", "high": "to"})
    return (
        rows.select("d1", "d2", "k1", "k2", "low")
        .join(marks, ["d1", "d2"])
        .groupBy("k1", "k2")
        .agg(F.collect_list(F.struct((F.col("low") + F.col("from")).alias("low"), (F.col("low") + F.col("to")).alias("high"))).alias("spans"))
    )


def kept_bytes(data: bytes, spans: list[dict] | None) -> tuple[bytes, int]:
    """What stays of the text, and the number of runs that go; spans are ranges of windows."""
    if not spans:
        return data, 0
    out, at = [], 0
    gone = merged([(s["low"], s["high"] + WINDOW - 1) for s in spans])
    for low, high in gone:
        out.append(data[at:low])
        at = high + 1
    out.append(data[at:])
    return b"".join(out), len(gone)


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(k1, k2, text, copies) of the distinct texts; the keys are two hashes of the text."""
    keys = text_keys(F.coalesce("text", F.lit("")))
    return (
        docs.select(*keys, F.coalesce("text", F.lit("")).alias("text"))
        .groupBy("k1", "k2")
        .agg(F.any_value("text").alias("text"), F.count("*").alias("copies"))
    )


def text_keys(text) -> list:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def cut_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct texts of ``docs`` (k1, k2, text, copies), and ranges of repeated windows (k1, k2, spans).

    A text with copies is repeated as a whole: its copies count in every anchor and passage.
    """
    ship(docs.sparkSession)
    texts = staged(distinct_texts(docs), "distinct-texts")
    return texts, repeated_spans(texts)


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with ``kept``, the bytes that occur nowhere else, beside the text; a null text keeps no bytes."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column("text").to_pylist(), batch.column("spans").to_pylist()
            kept = [kept_bytes(t.encode("utf-8", "replace"), s)[0] for t, s in zip(texts, spans)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("k1", "k2")), pa.array(kept, pa.binary())], ["k1", "k2", "kept"])

    texts, spans = cut_texts(docs)
    kept = texts.join(spans, ["k1", "k2"], "left").mapInArrow(rewrite, "k1 long, k2 long, kept binary")
    return with_results(docs, kept, ["kept"])


def with_results(docs: DataFrame, results: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` and what its texts have in ``results``; own columns of these names are replaced."""
    k1, k2 = text_keys(F.coalesce("text", F.lit("")))
    own = [c for c in docs.columns if c not in columns]
    docs = docs.select(*own, k1.alias("_sievecraft_k1"), k2.alias("_sievecraft_k2"))
    results = results.withColumnsRenamed({"k1": "_sievecraft_k1", "k2": "_sievecraft_k2"})
    return docs.join(results, ["_sievecraft_k1", "_sievecraft_k2"]).select(*own, *columns)


def op11_two_stage_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, bytes and runs removed, and a digest of what stays, for every document."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts, spans = cut_texts(docs)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                data = text.encode("utf-8", "replace")
                kept, n = kept_bytes(data, spans)
                for column, value in zip(out, (len(data), len(data) - len(kept), n, hashlib.sha256(kept).hexdigest())):
                    column.append(value)
            kinds = [pa.int64()] * 3 + [pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("k1"), batch.column("k2"), *(pa.array(c, k) for c, k in zip(out, kinds))],
                ["k1", "k2", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    digests = texts.join(spans, ["k1", "k2"], "left").select("k1", "k2", "text", "spans").mapInArrow(
        digest, "k1 long, k2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
    return with_results(docs, digests, ["n_bytes", "n_removed", "n_spans", "kept_sha256"]).drop("text")
