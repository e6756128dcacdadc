"""Words, hashes and labelled samples that several operators share."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multipliers of a running hash, by place, and the two rounds of its finish.
PLACES = (np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
ROUND_1, ROUND_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: str) -> bytes:
    """UTF-8 with A-Z lowered and every other byte as it is (bytes.lower() touches ASCII letters only)."""
    return text.encode("utf-8", "replace").lower()


def words_of(data: bytes) -> list[bytes]:
    """The runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return."""
    return data.split()


#: What words are made of: every byte but space, tab, line feed, vertical tab, form feed and carriage return.
WORD_BYTES = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def numbered_words(data: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """A number for each maximal run of letters (by byte) of ``data``, what the numbers stand for, and where runs start."""
    inside = letters[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(data) and inside[0]:
        edge = np.concatenate([[0], edge])
    if len(edge) % 2:
        edge = np.append(edge, len(data))
    start, stop = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.int64), [], np.empty(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum(stop - start)]).astype(np.int32)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]
    words = pa.Array.from_buffers(pa.binary(), len(start), buffers).dictionary_encode()
    return words.indices.to_numpy().astype(np.int64), words.dictionary.to_pylist(), start


def word_hashes(words: Iterable[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * ROUND_1
    x = (x ^ (x >> np.uint64(27))) * ROUND_2
    return x ^ (x >> np.uint64(31))


def run_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of every run of ``k`` consecutive words; empty if there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += mixed(hashes[j : j + n] + PLACES[j % 64] * np.uint64(j // 64 + 1))
    return mixed(total)


def shingle_set(data: bytes, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles; the whole sequence is one where there are fewer words."""
    words = words_of(data)
    if not words:
        return np.empty(0, np.uint64)
    hashes = word_hashes(words)
    return np.unique(run_hashes(hashes, min(k, len(words))))


def crc32_of_id(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def held_out(doc_id: Column, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder modulo 5; false without an id."""
    return F.coalesce(F.pmod(crc32_of_id(doc_id), F.lit(5)) == remainder, F.lit(False))


def is_held_out(doc_id: int | None, remainder: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == remainder


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[list[str], np.ndarray]:
    """At most ``per_class`` training texts of each value of ``label``, the same ones in every run.

    Held-out rows never get in; a document without text counts as an empty one, one with several labels keeps them all.
    Only ids and labels are sampled, by a hash of the id; the texts follow by a broadcast of those ids, of which there
    are at most twice ``per_class``.
    """
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"), 0) & F.col("doc_id").isNotNull())
    known = known.select("doc_id", F.col(label).cast("int").alias("label")).distinct()
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(*order).limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "label")
        .agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
        .collect()
    )
    rows.sort(key=lambda r: (r["doc_id"], r["label"]))
    return [r["text"] for r in rows], np.array([r["label"] for r in rows], dtype=np.int64)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The batch's texts; a missing one is empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that end with a whole run of equal keys, and where runs begin; the input is sorted by the keys."""
    held: list[pa.RecordBatch] = []

    def starts_of(part: pa.Table) -> np.ndarray:
        change = np.zeros(part.num_rows, bool)
        change[0] = True
        for k in keys:
            values = part.column(k).to_numpy()
            change[1:] |= values[1:] != values[:-1]
        return np.flatnonzero(change)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        part = pa.Table.from_batches(held)
        starts = starts_of(part)
        if len(starts) > 1:
            yield part.slice(0, starts[-1]), starts[:-1]
            held = part.slice(starts[-1]).combine_chunks().to_batches()
    if held:
        part = pa.Table.from_batches(held)
        yield part, starts_of(part)
