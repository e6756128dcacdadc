"""Vector bin packing of tokenised documents into training sequences.

A piece is a run of one document's tokens with three sizes: tokens, segments (1) and loss-bearing tokens. A sequence is a
bin with a capacity in each of the three. A bin takes, again and again, the piece that fits and has the largest dot
product with what is left of the bin (both divided by the capacities): pieces that use the plentiful dimensions first.
Documents longer than a sequence are cut there; only the last piece of a document has to be packed.

Pieces are packed in groups of about ``GROUP`` pieces, dealt by a row number that is written with the pieces, so equal
rows spread over groups and a repeated task repeats its result. A group leaves at most its last few bins half empty.

Defined results: a null text is empty, and an empty text is one piece that holds the end id alone; rows with a null or
repeated id are pieces of their own; ties in the dot product go to the earlier row number; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecraft.llm.text import table, texts_of
from sievecraft.scratch import staged
from sievecraft.shipping import ship

GROUP, SEQUENCE, MAX_SEGMENTS, END_ID = 2048, 2048, 256, 1


@lru_cache(maxsize=2)
def encoder(ranks_path: str | None = None):
    """The byte-level BPE as tiktoken runs it: the same ids as the JSON file's, at several times the speed (tested)."""
    import base64

    import public_tokenizers
    import tiktoken

    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
        special_tokens={"<|endoftext|>": len(ranks)},
    )


def ids_of(text: str, ranks_path: str | None = None) -> np.ndarray:
    """The document's ids and the end id."""
    ids = encoder(ranks_path).encode_to_numpy(text, allowed_special="all")
    return np.append(ids, END_ID).astype("<u4")


def pieces_of(
    docs: DataFrame, sequence: int = SEQUENCE, with_ids: bool = True, ranks_path: str | None = None
) -> DataFrame:
    """doc_id, start, tokens, segments, loss_tokens, ids_crc32, doc_tokens and, if asked for, ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # bounds what the ids of a batch take
                part = batch.slice(at, 512)
                docs_of, starts, lengths, sums, totals, ids_out = [], [], [], [], [], []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), texts_of(part)):
                    ids = ids_of(text, ranks_path)
                    for start in range(0, len(ids), sequence):
                        piece = ids[start : start + sequence]
                        docs_of.append(doc_id)
                        starts.append(start)
                        lengths.append(len(piece))
                        sums.append(zlib.crc32(piece.tobytes()))
                        totals.append(len(ids))
                        if with_ids:
                            ids_out.append(piece.astype(np.int32))
                size = np.array(lengths, dtype=np.int64)
                # a document's first token follows nothing, so it bears no loss
                loss = size - (np.array(starts, dtype=np.int64) == 0)
                columns = [
                    pa.array(docs_of, pa.int64()), pa.array(starts, pa.int64()), pa.array(size),
                    pa.array(np.ones(len(size), np.int64)), pa.array(loss), pa.array(sums, pa.int64()),
                    pa.array(totals, pa.int64()),
                ]
                names = ["doc_id", "start", "tokens", "segments", "loss_tokens", "ids_crc32", "doc_tokens"]
                if with_ids:
                    columns.append(pa.array(ids_out, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = (
        "doc_id long, start long, tokens long, segments long, loss_tokens long, ids_crc32 long, doc_tokens long"
        + ", ids array<int>" * with_ids
    )
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, schema)


def fill_bins(sizes: np.ndarray, capacity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin of each item, and where its tokens (the first size) begin there. A larger item than a bin is an error."""
    if len(sizes) and (sizes > capacity).any():
        raise ValueError("an item is larger than a sequence")
    order = np.argsort(-sizes[:, 0], kind="stable")
    items, free = sizes[order].astype(np.int64), np.ones(len(sizes), bool)
    share = items / capacity
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    number, first = 0, 0
    while first < len(items):
        left, chosen = capacity.astype(np.int64).copy(), first
        while chosen >= 0:
            bins[order[chosen]], offsets[order[chosen]] = number, capacity[0] - left[0]
            left -= items[chosen]
            free[chosen] = False
            if left[0] <= 0 or left[1] <= 0:
                break
            # items are in order of tokens, so those that fit begin at one place
            start = max(first, int(np.searchsorted(-items[:, 0], -left[0])))
            fits = free[start:] & (items[start:, 1] <= left[1]) & (items[start:, 2] <= left[2])
            scores = np.where(fits, share[start:] @ (left / capacity), -1.0)
            best = int(np.argmax(scores)) if len(scores) else 0
            chosen = start + best if len(scores) and scores[best] >= 0 else -1
        number += 1
        while first < len(items) and not free[first]:
            first += 1
    return bins, offsets


def pack(
    pieces: DataFrame, tokens: int = SEQUENCE, segments: int = MAX_SEGMENTS, loss_tokens: int | None = None,
    group: int = GROUP,
) -> DataFrame:
    """``pieces`` (with tokens, segments and loss_tokens) with ``sequence_id`` and ``offset``."""
    ship(pieces.sparkSession)
    rows = staged(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-rows.count() // group))
    capacity = np.array([tokens, segments, tokens if loss_tokens is None else loss_tokens], dtype=np.int64)

    def place(part: pa.Table) -> pa.Table:
        part = part.sort_by("_row")
        sizes = np.stack([part.column(c).to_numpy() for c in ("tokens", "segments", "loss_tokens")], axis=1)
        bins, offsets = fill_bins(sizes, capacity)
        number = part.column("_group").to_numpy() * (1 << 32) + bins
        part = part.append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offsets))
        return part.drop_columns(["_row", "_group"])

    dealt = rows.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))
    schema = pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    return dealt.groupBy("_group").applyInArrow(place, schema)


def sequences(packed: DataFrame, length: int = SEQUENCE, pad_id: int = 0) -> DataFrame:
    """sequence_id, input_ids and segment_lengths; padded to ``length`` except where the tokens are a power of two."""
    pieces = F.array_sort(F.collect_list(F.struct("offset", "tokens", "ids")))
    rows = packed.groupBy("sequence_id").agg(pieces.alias("pieces"))
    ids, n = F.flatten(F.col("pieces.ids")), F.aggregate("pieces.tokens", F.lit(0).cast("long"), lambda a, b: a + b)
    power = F.bit_count(n) == 1
    pad = F.when(power, F.lit(0)).otherwise(F.lit(length) - n).cast("int")
    return rows.select(
        "sequence_id",
        F.concat(ids, F.array_repeat(F.lit(pad_id), pad)).alias("input_ids"),
        F.col("pieces.tokens").alias("segment_lengths"),
    )


def packed_documents(docs: DataFrame) -> DataFrame:
    packed = pack(pieces_of(docs, with_ids=False))
    return packed.select(
        "doc_id", "start", F.col("tokens").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op1_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place."""
    return packed_documents(table(spark, sf_dir, "documents"))
