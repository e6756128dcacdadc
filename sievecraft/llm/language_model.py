"""Language-model scores from an Elias-Fano n-gram trie, cut into the slices that blocks of documents need.

The model is a smoothed bigram: ``P(w | h) = (c(hw) + MASS * P(w)) / (c(h) + MASS)`` with the base's ``P(w)``. Its counts
are over all training documents and grow with them, so no machine holds the whole of it:

1. Texts are split into words once. A block of documents is written as the sorted hashes of its distinct words and a number
   for each word; it has a name of its own from then on, and every later step reads what was written.
2. A block sends its distinct words and word pairs (sorted 64-bit hashes, as differences) with its own training counts to
   the counting tasks, by hash range. A frequent word travels once for each block, whatever its count.
   There are as many ranges as the number of words asks for.
3. A counting task adds up and answers each block in the block's own order, so answers carry counts only.
4. The block's words and answers meet; the slice of the model becomes a trie with monotone pointers and 16-bit
   probabilities in one mapped buffer, which is asked for each distinct word and pair of the block's texts.

Defined results: null and empty texts are the end alone; rows with null or repeated ids are scored each (without an id
they train); without training documents every token is unknown and has probability 1; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecraft.llm.elias_fano import Trie, anonymous_map
from sievecraft.llm.text import WORD_BYTES, held_out, is_held_out, lower_ascii, mixed, numbered_words, runs, table, word_hashes
from sievecraft.scratch import staged
from sievecraft.shipping import ship

#: Weight of the base distribution after each context; bytes of text in a block; remainder of the held-out fifth.
MASS, BLOCK_BYTES, REMAINDER = 100.0, 2 << 20, 1
#: Words for one range of hashes.
RANGE_WORDS = 1_000_000
#: Hashes of the end and of the start of a text (the start is only ever a context).
END, START = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC2B2AE3D27D4EB4F)

BLOCK = "block long, n long, ids array<long>, sizes binary, words binary, codes binary"


class Block:
    """A block's documents as numbers of words, in the order of the words' hashes; each text ends with the end.

    ``pairs`` are the distinct pairs (context, word) in this order; the context one past the last word is a text's start.
    """

    def __init__(self, ids: list[int | None], sizes: np.ndarray, words: np.ndarray, codes: np.ndarray) -> None:
        self.ids, self.sizes, self.words, self.codes = ids, sizes, words, codes.astype(np.int64)
        self.starts = np.cumsum(sizes) - sizes
        before = np.concatenate([[0], self.codes[:-1]])
        before[self.starts] = len(words)
        width = len(words) + 1
        self.pairs, self.of_pair = np.unique(before * width + self.codes, return_inverse=True)
        self.context, self.follower = self.pairs // width, self.pairs % width
        trains = np.array([not is_held_out(i, REMAINDER) for i in ids], dtype=bool)
        self.trains = np.repeat(trains, sizes)
        hashes = np.append(words, START)
        pair_hashes = mixed(mixed(hashes[self.context] ^ np.uint64(0x51)) + hashes[self.follower])
        self.keys, self.of_key = np.unique(pair_hashes, return_inverse=True)

    @classmethod
    def of_texts(cls, ids: list[int | None], texts: list[str | None]) -> Block:
        return cls(ids, *numbered_texts(texts))

    @classmethod
    def of_row(cls, row: dict) -> Block:
        return cls(row["ids"], from_planes(row["sizes"], "<i8"), unpacked_keys(row["words"]), from_planes(row["codes"], "<u4"))

    def asked(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys of a level, sorted, and the block's own training occurrences of each."""
        if level == 0:
            return self.words, np.bincount(self.codes[self.trains], minlength=len(self.words))
        counts = np.bincount(self.of_pair[self.trains], minlength=len(self.pairs))
        return self.keys, np.bincount(self.of_key, counts, minlength=len(self.keys)).astype(np.int64)


def numbered_texts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text and the end, counted; sorted hashes of the distinct words; a number for each word."""
    lowered = [lower_ascii(t or "") for t in texts]
    data = np.frombuffer(b"\n".join(lowered), np.uint8)
    codes, words, start = numbered_words(data, WORD_BYTES)
    hashes, number = np.unique(np.append(word_hashes(words), END), return_inverse=True)
    lengths = np.fromiter(map(len, lowered), np.int64, len(lowered)) + 1
    begins = np.cumsum(lengths) - lengths
    before = np.searchsorted(start, begins)
    sizes = np.diff(np.append(before, len(codes))) + 1
    text = np.repeat(np.arange(len(texts)), sizes - 1)
    out = np.full(int(sizes.sum()), number[-1])
    out[np.arange(len(codes)) + text] = number[codes] if len(codes) else codes
    return sizes, hashes, out


def blocks_of(docs: DataFrame) -> DataFrame:
    """Rows (block, n, ids, sizes, words, codes) of the documents, to be stored: names are drawn."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        texts: list[str | None] = []
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids.append(doc_id)
                    texts.append(text)
                    size += len(text or "") + 1
                    if size >= BLOCK_BYTES:
                        yield row(ids, texts)
                        ids, texts, size = [], [], 0
        if ids:
            yield row(ids, texts)

    def row(ids: list[int | None], texts: list[str | None]) -> pa.RecordBatch:
        sizes, words, codes = numbered_texts(texts)
        columns = [
            pa.array([secrets.randbits(62)]), pa.array([len(codes)]), pa.array([ids], pa.list_(pa.int64())),
            pa.array([planes(sizes.astype("<i8"))]), pa.array([packed_keys(words)]), pa.array([planes(codes.astype("<u4"))]),
        ]
        return pa.RecordBatch.from_arrays(columns, ["block", "n", "ids", "sizes", "words", "codes"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(number, BLOCK)


def planes(values: np.ndarray) -> bytes:
    """All first bytes, then all second bytes and so on, compressed: what is zero, or nearly the same, lies together."""
    flat = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return zstandard.ZstdCompressor(level=1).compress(flat.tobytes())


def from_planes(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(flat.reshape(width, -1).T).reshape(-1).view(kind)


def packed_keys(keys: np.ndarray) -> bytes:
    return planes(np.diff(keys, prepend=np.uint64(0)).astype("<u8"))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, "<u8"), dtype=np.uint64) if data else np.empty(0, np.uint64)


def requests(blocks: DataFrame, ranges: int) -> DataFrame:
    """Rows (range, level, block, keys, counts): what each block has in each range of hashes."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = np.array([(r << 64) // ranges for r in range(ranges)], dtype=np.uint64)
        for batch in batches:
            for i in range(batch.num_rows):
                (own,) = batch.slice(i, 1).to_pylist()
                block = Block.of_row(own)
                for level in (0, 1):
                    keys, counts = block.asked(level)
                    cuts = np.append(np.searchsorted(keys, bounds), len(keys))
                    some = np.flatnonzero(cuts[1:] > cuts[:-1])
                    spans = [slice(cuts[r], cuts[r + 1]) for r in some]
                    counts = counts.astype("<u4")
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(some, pa.int32()), pa.array([level] * len(some), pa.int32()),
                            pa.array([own["block"]] * len(some), pa.int64()),
                            pa.array([packed_keys(keys[s]) for s in spans], pa.binary()),
                            pa.array([planes(counts[s]) for s in spans], pa.binary()),
                        ],
                        ["range", "level", "block", "keys", "counts"],
                    )

    return blocks.mapInArrow(ask, "range int, level int, block long, keys binary, counts binary")


def answers(asked: DataFrame) -> DataFrame:
    """Rows (block, level, range, totals) in the order of the block's keys; (distinct, tokens) of level 0 with block null."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, starts in runs(batches, ("range", "level")):
            for start, stop in zip(starts, np.append(starts[1:], part.num_rows)):
                own = part.slice(start, stop - start)
                level, number = own.column("level")[0].as_py(), own.column("range")[0].as_py()
                keys = [unpacked_keys(k) for k in own.column("keys").to_pylist()]
                counts = np.concatenate([from_planes(c, "<u4") for c in own.column("counts").to_pylist()])
                every = np.concatenate(keys)
                order = np.argsort(every, kind="stable")
                new = np.concatenate([[True], every[order][1:] != every[order][:-1]])
                sums = np.add.reduceat(counts[order].astype(np.int64), np.flatnonzero(new))
                totals = np.empty(len(every), np.int64)
                totals[order] = sums[np.cumsum(new) - 1]
                cuts = np.cumsum([len(k) for k in keys])[:-1]
                blobs = [planes(t.astype("<u8")) for t in np.split(totals, cuts)]
                n = len(blobs)
                stats = [[None] * n, [None] * n]
                blocks, levels = own.column("block").to_pylist(), [level] * n
                if level == 0:
                    blocks, levels, blobs = [*blocks, None], [*levels, 0], [*blobs, None]
                    stats = [[None] * n + [int((sums > 0).sum())], [None] * n + [int(sums.sum())]]
                columns = [
                    pa.array(blocks, pa.int64()), pa.array(levels, pa.int32()),
                    pa.array([number] * len(blocks), pa.int32()), pa.array(blobs, pa.binary()),
                    pa.array(stats[0], pa.int64()), pa.array(stats[1], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["block", "level", "range", "totals", "distinct", "tokens"])

    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = asked.repartition(parts, "range", "level").sortWithinPartitions("range", "level")
    return dealt.mapInArrow(count, "block long, level int, range int, totals binary, distinct long, tokens long")


def slice_of(block: Block, totals: list[np.ndarray], train_tokens: int, distinct: int, mass: float = MASS) -> bytes:
    """The trie of what the block can ask for; ``totals`` are in the order of the block's keys."""
    words, counts = block.words, totals[0]
    p1 = (counts + 0.5) / (train_tokens + 0.5 * (distinct + 1))
    # the start of a text is followed once for each training document, as the end is preceded
    end = np.searchsorted(words, END)
    after = np.append(counts, counts[end] if end < len(words) and words[end] == END else 0)
    pairs = totals[1][block.of_key]
    seen = pairs > 0
    context, follower, pairs = block.context[seen], block.follower[seen], pairs[seen]
    back = np.log10(mass / (after + mass))
    log2 = np.log10((pairs + mass * p1[follower]) / (after[context] + mass))
    return Trie.build(words, counts, np.log10(p1), back, context, follower, log2)


def scored(docs: DataFrame, mass: float = MASS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``."""
    ship(docs.sparkSession)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = staged(blocks_of(docs), "word-blocks")
    words = int(blocks.agg(F.sum("n")).first()[0] or 0)
    replies = staged(answers(requests(blocks, max(2 * parts, -(-words // RANGE_WORDS)))), "counts")
    stats = replies.where("block is null").agg(F.sum("distinct"), F.sum("tokens")).first()
    distinct, train_tokens = int(stats[0] or 0), int(stats[1] or 0)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, starts in runs(batches, ("block",)):
            for start, stop in zip(starts, np.append(starts[1:], part.num_rows)):
                own = part.slice(start, stop - start)
                level = own.column("level").to_numpy()
                blobs = own.column("totals").to_pylist()
                block = Block.of_row(own.slice(len(level) - 1).to_pylist()[0])
                # answers come sorted by level and range, which is the order of the block's keys
                totals = [
                    np.concatenate([from_planes(b, "<u8").astype(np.int64) for b, l in zip(blobs, level) if l == n])
                    for n in (0, 1)
                ]
                trie = Trie.map(anonymous_map(slice_of(block, totals, train_tokens, distinct, mass)))
                word = np.append(trie.numbers(block.words), trie.words.size)
                counts = trie.counts.astype(np.int64)[word[:-1]]
                base = np.log10((counts + 0.5) / (train_tokens + 0.5 * (distinct + 1)))
                pairs = trie.log10(word[block.context], word[block.follower])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(block.ids, pa.int64()), pa.array(block.sizes),
                        pa.array(np.add.reduceat((counts > 0).astype(np.int64)[block.codes], block.starts)),
                        pa.array(np.add.reduceat(base[block.codes], block.starts)),
                        pa.array(np.add.reduceat(pairs[block.of_pair], block.starts)),
                    ],
                    ["doc_id", "n_tokens", "n_known", "base_score", "score"],
                )

    none = F.lit(None).cast("binary").alias("totals")
    rows = blocks.select("block", F.lit(2).alias("level"), F.lit(0).alias("range"), "ids", "sizes", "words", "codes", none)
    counts = replies.where("block is not null").select("block", "level", "range", "totals")
    met = rows.unionByName(counts, allowMissingColumns=True).repartition(parts, "block").sortWithinPartitions("block", "level", "range")
    out = met.mapInArrow(score, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(train_tokens).cast("long"))


def op3_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of every document."""
    return scored(table(spark, sf_dir, "documents")).select(
        "doc_id", held_out(F.col("doc_id"), REMAINDER).alias("held_out"), "n_tokens", "n_known", "train_tokens",
        "base_score", "score",
    )
