"""Spelling variants: words one edit apart, by a dictionary of pairs of trie nodes.

1. The words are sorted over the cluster and numbered in ranges. Within a range a prefix shared with the word before has
   that word's trie node, and every longer prefix gets the next number. What the first word of a range shares with the
   last word of the range before is put right from a table of one row a range. The same over the reversed words numbers
   suffixes.
2. A word with one place skipped is an integer pair (node of the prefix before it, node of the suffix after it). A word
   split between two places is such a pair too, (prefix, suffix) without a place left out.
3. Skipped pairs that are equal belong to words that differ in that place only; a skipped pair that equals a split one
   belongs to a word with one code point more. Node numbers stand for exactly one string, so nothing needs to be verified.
   A pair has at most one split word and one skipped word for each code point, so groups are bounded by the alphabet.
   Of equal neighbouring code points only the first is skipped against split words: each neighbour is found once.
4. Each word's neighbour of most occurrences is its form if it is ``ratio`` times as frequent; forms are followed to roots
   by pointer doubling, as occurrences grow by that ratio at every step.

Defined results: null and empty texts have no words; a row without an id loses no code point; repeated rows count each;
words of any length are whole; ties between neighbours go to the smaller word in code-point order; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecraft.llm.text import runs, table
from sievecraft.scratch import staged
from sievecraft.shipping import ship

#: Code points of a word at least, occurrences at least, how much more frequent a form is, one run in so many is misspelt.
LENGTH, LEAST, RATIO, MISSPELT = 7, 2, 10, 31
#: Words that a task counts at a time.
HELD = 300_000


def damaged(run: str, start: int) -> str:
    """The run, or without one code point where the checksum of id and run, begun with ``start``, says so."""
    h = zlib.crc32(run.encode(), start)
    if h % MISSPELT:
        return run
    place = h % len(run)
    return run[:place] + run[place + 1 :]


def word_counts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(word, n) of the runs of letters of all texts, after damage, of ``length`` code points or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs_of = re.compile("[a-zÀ-ÿ]{%d,}" % length).findall
        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"]
            )
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = runs_of(text.encode("utf-8", "replace").lower().decode("utf-8"))
                if doc_id is None:
                    held.update(found)
                    continue
                start = zlib.crc32(b"%d:" % doc_id)
                for run, n in Counter(found).items():
                    word = damaged(run, start)
                    if len(word) >= length:
                        held[word] += n
                if len(held) >= HELD:
                    yield rows()
        yield rows()

    docs = docs.select(F.col("doc_id").cast("long"), "text").where("text is not null")
    return docs.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def shared(a: str, b: str) -> int:
    """The length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def numbered(words: DataFrame, word: str, nodes: str, fields: str) -> tuple[DataFrame, dict[int, tuple[int, list[int]]]]:
    """Adds ``nodes``, the trie nodes of the word's prefixes of length 1, 2 and so on, numbered within each range of words.

    Also returns for each range what makes these numbers global: an offset for all of them, but the listed numbers for the
    first ones (the nodes that the range's first word shares with words of earlier ranges). ``words`` gets ``part`` and
    ``place``, the range and the place in it, in the order of words.
    """
    names = [f.split()[0] for f in fields.split(", ")]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, last, path, count = None, 0, "", [], 0
        for batch in batches:
            lists, places, spellings = [], [], batch.column(names.index(word)).to_pylist()
            for own, spelling in zip(batch.column("part").to_pylist(), spellings):
                if own != part:
                    part, place, last, path, count = own, 0, "", [], 0
                same = shared(last, spelling)
                more = len(spelling) - same
                path = path[:same] + list(range(count + 1, count + more + 1))
                count += more
                last = spelling
                lists.append(path)
                places.append(place)
                place += 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), batch.column("part"), pa.array(places, pa.int64()),
                 pa.array(lists, pa.list_(pa.int64()))],
                [*names, "part", "place", nodes],
            )

    spark = words.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = staged(words.repartitionByRange(parts, word).withColumn("part", F.spark_partition_id()), "word-ranges")
    dealt = ranges.repartition(parts, "part").sortWithinPartitions("part", word)
    out = staged(dealt.mapInArrow(number, f"{fields}, part int, place long, {nodes} array<long>"), "trie-nodes")
    ends = out.groupBy("part").agg(
        F.min(word).alias("first"), F.max(F.struct(word, nodes)).alias("last"), F.max(F.array_max(nodes)).alias("count")
    )
    # one row for each range
    offset, known, before, fix = 0, [], "", {}
    for row in sorted(ends.collect(), key=lambda r: r["part"]):
        same = shared(before, row["first"])
        fix[row["part"]] = (offset, known[:same])
        before = row["last"][word]
        known = [known[x - 1] if x <= same else offset + x for x in row["last"][nodes]]
        offset += row["count"]
    return out, fix


def made_global(nodes: np.ndarray, part: np.ndarray, fix: dict[int, tuple[int, list[int]]]) -> np.ndarray:
    """Nodes numbered within ranges as nodes of the whole trie."""
    out = np.empty_like(nodes)
    for own in np.unique(part):
        offset, first = fix[int(own)]
        mine = part == own
        local = nodes[mine]
        value = local + offset
        low = local <= len(first)
        value[low] = np.array(first, np.int64)[local[low] - 1]
        out[mine] = value
    return out


def node_pairs(words: DataFrame, forward: dict, backward: dict) -> DataFrame:
    """Rows (f, r, id, n, kind) of every pair of nodes of each word.

    ``kind`` is 0 for a split, 1 for a skipped place, 2 for one whose code point is that of the place before.
    """

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                yield pairs_of(batch.slice(at, 8192))

    def pairs_of(part: pa.RecordBatch) -> pa.RecordBatch:
        column = {n: part.column(n) for n in part.schema.names}
        size = np.array([len(x) for x in column["fnodes"].to_pylist()], np.int64)
        each = np.repeat(np.arange(len(size)), size)
        before = np.cumsum(size) - size
        f = made_global(column["fnodes"].flatten().to_numpy(), column["fpart"].to_numpy()[each], forward)
        r = made_global(column["rnodes"].flatten().to_numpy(), column["rpart"].to_numpy()[each], backward)
        # per word: nodes of the prefixes of length 0 to L and, at L - k, of the suffixes that begin at place k
        whole = size + 1
        row = np.repeat(np.arange(len(size)), whole)
        place = np.arange(whole.sum()) - np.repeat(np.cumsum(whole) - whole, whole)
        left = place - 1
        prefix = np.where(left >= 0, f[np.maximum(before[row] + left, 0)], 0)
        right = size[row] - place - 1
        suffix = np.where(right >= 0, r[np.maximum(before[row] + right, 0)], 0)
        skip = place < size[row]
        points = np.concatenate([np.frombuffer(w.encode("utf-32-le"), "<u4") for w in column["word"].to_pylist()])
        again = np.concatenate([[False], points[1:] == points[:-1]])
        again[before[size > 0]] = False
        after = np.append(suffix[1:], 0)[skip]
        ids, counts = column["id"].to_numpy(), column["n"].to_numpy()
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([prefix, prefix[skip]])),
                pa.array(np.concatenate([suffix, after])),
                pa.array(np.concatenate([ids[row], ids[row][skip]])),
                pa.array(np.concatenate([counts[row], counts[row][skip]])),
                pa.array(np.concatenate([np.zeros(len(row), np.int8), again.astype(np.int8) + np.int8(1)])),
            ],
            ["f", "r", "id", "n", "kind"],
        )

    return words.mapInArrow(lay_out, "f long, r long, id long, n long, kind byte")


def neighbours(pairs: DataFrame) -> DataFrame:
    """Rows (id, near, best_n, best): near words found under one pair, and the most frequent of them."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, starts in runs(batches, ("f", "r")):
            size = np.diff(np.append(starts, part.num_rows))
            keep = np.repeat(size > 1, size)
            if not keep.any():
                continue
            size = size[size > 1]
            ids, n, kind = (part.column(c).to_numpy()[keep] for c in ("id", "n", "kind"))
            group = np.repeat(np.arange(len(size)), size)
            # within a pair the most frequent word first, then the smallest
            order = np.lexsort((ids, -n, group))
            ids, n, kind = ids[order], n[order], kind[order]
            low, at, none = np.cumsum(size) - size, np.arange(len(ids)), len(ids)
            skip, free, split = kind > 0, kind == 1, kind == 0
            first = np.minimum.reduceat(np.where(skip, at, none), low)[group]
            second = np.minimum.reduceat(np.where(skip & (at != first), at, none), low)[group]
            first_free = np.minimum.reduceat(np.where(free, at, none), low)[group]
            own_split = np.minimum.reduceat(np.where(split, at, none), low)[group]
            skips = np.add.reduceat(skip.astype(np.int64), low)[group]
            frees = np.add.reduceat(free.astype(np.int64), low)[group]
            near = np.where(skip, skips - 1 + (free & (own_split < none)), frees)
            other = np.where(split, first_free, np.where(at == first, second, first))
            # rows are in order of preference, so the better of two is the one that comes first
            best = np.where(free, np.minimum(other, own_split), other)
            found = near > 0
            best = best[found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[found]), pa.array(near[found]), pa.array(n[best]), pa.array(ids[best])],
                ["id", "near", "best_n", "best"],
            )

    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pairs.repartition(parts, "f", "r").sortWithinPartitions("f", "r")
    return dealt.mapInArrow(compare, "id long, near long, best_n long, best long")


def roots(forms: DataFrame) -> DataFrame:
    """(id, root) from (id, form): forms followed to the last, doubling the steps each round."""
    at = staged(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("id").alias("root"), F.col("root").alias("next"))
        moved = staged(at.join(ahead, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")), "roots")
        if moved.where("went").isEmpty():
            return moved.drop("went")
        at = moved.drop("went")


def variant_groups(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of ``words`` (distinct word, n)."""
    ship(words.sparkSession)
    forward, forward_fix = numbered(words.select("word", "n"), "word", "fnodes", "word string, n long")
    # the order of ids is that of words
    forward = forward.withColumn("id", F.shiftleft(F.col("part").cast("long"), 40) + F.col("place"))
    turned = forward.select(F.reverse("word").alias("turned"), "id")
    backward, backward_fix = numbered(turned, "turned", "rnodes", "turned string, id long")
    both = forward.select("id", "word", "n", F.col("part").alias("fpart"), "fnodes").join(
        backward.select("id", F.col("part").alias("rpart"), "rnodes"), "id"
    )
    found = neighbours(node_pairs(both, forward_fix, backward_fix)).groupBy("id").agg(
        F.sum("near").alias("n_near"), F.max(F.struct("best_n", (-F.col("best")).alias("best"))).alias("best")
    )
    names = forward.select("id", "word", "n")
    found = names.join(found, "id", "left")
    usable = F.col("best.best_n") >= ratio * F.col("n")
    found = staged(
        found.select(
            "id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(usable, -F.col("best.best")).alias("form"), F.when(usable, F.col("best.best_n")).alias("form_n"),
        ),
        "neighbours",
    )
    ends = roots(found.where("form is not null").select("id", "form"))
    spelt = names.select(F.col("id").alias("form"), F.col("word").alias("form_word"))
    rooted = names.select(F.col("id").alias("root"), F.col("word").alias("root_word"))
    with_forms = found.where("form is not null").join(ends, "id").join(spelt, "form").join(rooted, "root")
    none = F.lit(None).cast("string")
    return with_forms.select(
        "word", F.col("form_word").alias("form"), F.col("root_word").alias("root"), "n", "n_near", "form_n"
    ).unionByName(
        found.where("form is null").select("word", none.alias("form"), F.col("word").alias("root"), "n", "n_near", "form_n")
    )


def op13_trie_pair_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, form and root of every word of seven letters or more that occurs twice."""
    counts = word_counts(table(spark, sf_dir, "documents")).where(F.col("n") >= LEAST)
    return variant_groups(staged(counts, "vocabulary"))
