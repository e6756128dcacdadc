"""Phrases of two to five words that hold together, by stripes: a prefix keys a counter of the words that follow it.

Texts are cut into pieces at punctuation and line breaks, and pieces into words; all counts are per language. One order of
phrases after the other:

1. A task numbers the words of a stretch of documents and counts the followers of each prefix (the empty prefix's counter
   is that of single words). It sends a stripe for each prefix: the followers, joined, and their counts.
2. Stripes of a prefix are merged elementwise, and entries that occur often enough are kept: ``stripe[prefix][word]`` is the
   total of the phrase, and the total of the empty prefix's stripe is the number of words.
3. A phrase can only be frequent if its first and its last words but one are. So before the next order a bitmap of hashes
   of what is frequent goes to the tasks; its size is fixed, and a false hit costs a counter entry, never a result.

A stripe is cut by the hash of the following word where its prefix makes up a thousandth of all words or more (there are
at most a thousand such prefixes), so no task merges the whole stripe of a hot prefix.

From the stripes come a phrase's extensions to the right (its own stripe) and to the left (stripes of longer prefixes that
end in it), whose maxima tell whether a longer phrase subsumes it, and the totals of its parts, which give the score.

Defined results: a null or empty text has no words; a null language is ``und``; repeated rows count each; ids are not read;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievecraft.llm.text import PLACES, mixed, numbered_words, run_hashes, runs, table, texts_of, word_hashes
from sievecraft.scratch import staged
from sievecraft.shipping import ship

#: Words of a phrase at most, least occurrences, phrases reported for each language.
WORDS, LEAST, TOP = 5, 100, 2000
#: Bits of the bitmap (8 MB), letters that a task counts at a time, parts of the empty prefix's stripe and of a hot one's.
BITS, HELD, FIRST_PARTS, HOT_PARTS, HOT_SHARE = 26, 10_000_000, 4096, 64, 1000

#: A-Z lowered; everything that ends a piece becomes a line feed.
FOLD = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))

#: What words are made of.
LETTER = ~np.isin(np.arange(256), [9, 10, 32])

ENTRY = "lang string, prefix binary, next binary, f long, hash long"


def words_in(data: bytes) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """The words of some texts: a number for each, what the numbers stand for, and the pieces that they lie in."""
    folded = np.frombuffer(data.translate(FOLD), np.uint8)
    codes, words, start = numbered_words(folded, LETTER)
    return codes, words, np.searchsorted(np.flatnonzero(folded == 10), start)


def language_seed(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode("utf-8", "replace")))


def phrase_hashes(lang: str, phrases: list[list[bytes]]) -> np.ndarray:
    """The hashes of phrases of one length, as ``run_hashes`` gives them for words in a row."""
    if not phrases:
        return np.empty(0, np.uint64)
    hashes = word_hashes(w for p in phrases for w in p).reshape(len(phrases), -1) ^ language_seed(lang)
    total = np.zeros(len(phrases), np.uint64)
    for j in range(hashes.shape[1]):
        total += mixed(hashes[:, j] + PLACES[j])
    return mixed(total)


def stripe_rows(lang: str, data: bytes, order: int, frequent: np.ndarray | None, hot: np.ndarray) -> pa.RecordBatch | None:
    """The stripes of some texts: followers of each prefix of ``order - 1`` words, with counts."""
    codes, words, piece = words_in(data)
    last = len(codes) - order + 1
    if last <= 0:
        return None
    hashes = word_hashes(words)
    size = len(words)
    if order == 1:
        counts = np.bincount(codes, minlength=size)
        follower = np.arange(size)
        prefix = at = np.zeros(size, np.int64)
        parts = (hashes % np.uint64(FIRST_PARTS)).astype(np.int64)
    else:
        grams = run_hashes(hashes[codes] ^ language_seed(lang), order - 1)
        bit = (grams >> np.uint64(64 - (len(frequent) * 64 - 1).bit_length())).astype(np.int64)
        known = (frequent[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) > 0
        alive = (piece[:last] == piece[order - 1 :]) & known[:last] & known[1 : last + 1]
        start = np.flatnonzero(alive)
        if not len(start):
            return None
        prefix = codes[start]
        for j in range(1, order - 1):
            prefix = np.unique(prefix * size + codes[start + j], return_inverse=True)[1]
        pairs, first, counts = np.unique(prefix * size + codes[start + order - 1], return_index=True, return_counts=True)
        prefix, follower, at = pairs // size, pairs % size, start[first]
        cut = np.isin(grams[at], hot)
        parts = np.where(cut, (hashes[follower] % np.uint64(HOT_PARTS)).astype(np.int64), 0)
    # equal prefixes lie together, so cutting by part keeps a stripe's rows together
    by = np.lexsort((parts, prefix))
    prefix, follower, at, counts, parts = prefix[by], follower[by], at[by], counts[by], parts[by]
    new = np.concatenate([[True], (prefix[1:] != prefix[:-1]) | (parts[1:] != parts[:-1])])
    low = np.flatnonzero(new)
    high = np.append(low[1:], len(new))
    names = [b" ".join([words[c] for c in codes[p : p + order - 1].tolist()]) for p in at[low].tolist()]
    listed = [words[c] for c in follower.tolist()]
    bounds = list(zip(low.tolist(), high.tolist()))
    counts = counts.astype("<u4")
    own_parts = parts[low]
    keys = [xxhash.xxh3_64_intdigest(n, p) for n, p in zip(names, own_parts.tolist())]
    keys = (np.array(keys, np.uint64) ^ language_seed(lang)).view(np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(keys), pa.array([lang] * len(low), pa.string()), pa.array(names, pa.binary()),
            pa.array(own_parts.astype(np.int32)), pa.array(np.add.reduceat(counts.astype(np.int64), low)),
            pa.array([b" ".join(listed[a:b]) for a, b in bounds], pa.binary()),
            pa.array([counts[a:b].tobytes() for a, b in bounds], pa.binary()),
        ],
        ["key", "lang", "prefix", "part", "total", "words", "counts"],
    )


def stripes(docs: DataFrame, order: int, frequent, hot: np.ndarray, held_bytes: int = HELD) -> DataFrame:
    """Stripes of every stretch of documents; ``frequent`` is a broadcast bitmap, None for single words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = defaultdict(list)
        bitmap = frequent.value if frequent is not None else None

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, texts in sorted(held.items()):
                rows = stripe_rows(lang, b"\n".join(texts), order, bitmap, hot)
                if rows is not None:
                    yield rows
            held.clear()

        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for lang, text in zip(part.column("lang").to_pylist(), texts_of(part)):
                    held[lang].append(text.encode("utf-8", "replace"))
                    size += len(text)
                if size >= held_bytes:
                    yield from flush()
                    size = 0
        yield from flush()

    return docs.mapInArrow(
        count, "key long, lang string, prefix binary, part int, total long, words binary, counts binary"
    )


def merged_stripes(rows: DataFrame, order: int, least: int) -> DataFrame:
    """Entries of the merged stripes that occur ``least`` times; for order 1 also each language's total, without a word."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, starts in runs(batches, ("key",)):
            total = part.column("total").to_numpy()
            columns = [part.column(c) for c in ("lang", "prefix", "words", "counts")]
            found: dict[str, list[tuple[bytes, bytes, int]]] = defaultdict(list)
            totals: dict[str, int] = defaultdict(int)
            if order == 1:
                for lang, n in zip(columns[0].to_pylist(), total.tolist()):
                    totals[lang] += n
            enough = np.add.reduceat(total, starts) >= least
            stops = np.append(starts[1:], part.num_rows)
            for start, stop in zip(starts[enough].tolist(), stops[enough].tolist()):
                stripe: dict[tuple[str, bytes], dict[bytes, int]] = {}
                for lang, prefix, words, counts in zip(*(c.slice(start, stop - start).to_pylist() for c in columns)):
                    pairs = zip(words.split(b" "), np.frombuffer(counts, "<u4").tolist())
                    own = stripe.get((lang, prefix))
                    if own is None:
                        stripe[lang, prefix] = dict(pairs)
                    else:
                        for word, n in pairs:
                            own[word] = own.get(word, 0) + n
                for (lang, prefix), own in stripe.items():
                    found[lang] += [(prefix, word, n) for word, n in own.items() if n >= least]
            for lang, n in totals.items():
                yield entries(lang, [(None, None, n)], None)
            for lang, some in found.items():
                phrases = [[*prefix.split(b" "), word] if prefix else [word] for prefix, word, _ in some]
                yield entries(lang, some, phrase_hashes(lang, phrases).view(np.int64))

    def entries(lang: str, some: list, hashes: np.ndarray | None) -> pa.RecordBatch:
        kinds = (pa.binary(), pa.binary(), pa.int64())
        columns = [pa.array([s[i] for s in some], kind) for i, kind in enumerate(kinds)]
        codes = pa.array(hashes, pa.int64()) if hashes is not None else pa.array([None] * len(some), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(some), pa.string()), *columns, codes], ["lang", "prefix", "next", "f", "hash"]
        )

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(merge, ENTRY)


def bitmap_of(entries: DataFrame, bits: int = BITS) -> np.ndarray:
    """One bit for each value of the leading ``bits`` of the phrases' hashes."""
    bit = F.shiftrightunsigned("hash", 64 - bits)
    words = (
        entries.groupBy(F.shiftright(bit, 6).alias("at"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(%d & shiftrightunsigned(hash, %d) as int))" % (63, 64 - bits))).alias("bits"))
        .toArrow()
    )
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def phrase_counts(
    docs: DataFrame, longest: int = WORDS, least: int = LEAST, bits: int = BITS, held_bytes: int = HELD
) -> tuple[DataFrame, DataFrame]:
    """(lang, prefix, next, f, words) of all phrases of up to ``longest`` words that occur ``least`` times, and words per language."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), "text")
    level = staged(merged_stripes(stripes(docs, 1, None, np.empty(0, np.uint64), held_bytes), 1, least), "words")
    sums = level.where("next is null").groupBy("lang").agg(F.sum("f").alias("n"))
    every = int(level.where("next is null").agg(F.sum("f")).first()[0] or 0)
    level = level.where("next is not null")
    levels = [level.withColumn("words", F.lit(1))]
    for order in range(2, longest + 1):
        bitmap = bitmap_of(level, bits)
        if not bitmap.any():
            break
        hot = level.where(F.col("f") * HOT_SHARE >= every).select("hash").toArrow().column("hash").to_numpy().view(np.uint64)
        seen = spark.sparkContext.broadcast(bitmap)
        level = staged(merged_stripes(stripes(docs, order, seen, hot, held_bytes), order, least), f"phrases-{order}")
        seen.destroy()
        levels.append(level.withColumn("words", F.lit(order)))
    counts = levels[0]
    for more in levels[1:]:
        counts = counts.unionByName(more)
    phrase = F.when(F.col("words") == 1, F.col("next")).otherwise(F.concat("prefix", F.lit(b" "), "next")).cast("string")
    return counts.select("lang", phrase.alias("phrase"), "words", "f"), sums


def collocations(docs: DataFrame, longest: int = WORDS, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The best ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    counts, sums = phrase_counts(docs, longest, least)
    counts = staged(counts, "phrase-counts")
    found = counts.where("words > 1")
    split = F.split("phrase", " ")
    # one word more on either side is enough: what lies between two phrases of equal counts has that count too
    extended = found.where("words > 2").select(
        "lang", "f", F.explode(F.array(
            F.array_join(F.slice(split, F.lit(1), F.col("words") - 1), " "),
            F.array_join(F.slice(split, F.lit(2), F.col("words") - 1), " "),
        )).alias("phrase"),
    )
    extended = extended.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = found.join(extended, ["lang", "phrase"], "left").where("longer is null or longer < f").drop("longer")
    cuts = kept.select(
        "lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), "words"
    ).select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice(split, F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice(split, F.col("k") + 1, F.col("words")), " ").alias("right"),
    )
    totals = counts.select("lang", "phrase", "f")
    cuts = cuts.join(totals.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(totals.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cuts = cuts.join(F.broadcast(sums) if sums.limit(1001).count() <= 1000 else sums, "lang")
    wide = "decimal(18, 0)"
    score = F.expr(f"(cast(1000 * a as {wide}) * cast(n as {wide})) div (cast(l as {wide}) * cast(r as {wide}))")
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = best.select("lang", "phrase", "a", "n", "cut.l", "cut.r", "cut.score").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score")
    )


def op12_stripes_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language."""
    return collocations(table(spark, sf_dir, "documents"))


#: The same in SQL: every phrase is laid out, so it is for small tables.
OP12_SQL = r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS words
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                      '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents WHERE text IS NOT NULL)
),
grams AS (
  SELECT lang, k, array_to_string(list_slice(words, i, i + k - 1), ' ') AS phrase
  FROM (SELECT lang, words, unnest(generate_series(1, len(words))) AS i FROM pieces WHERE len(words) > 0),
       (SELECT unnest([1, 2, 3, 4, 5]) AS k)
  WHERE i + k - 1 <= len(words)
),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(words)) AS n FROM pieces GROUP BY lang),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
longer AS (
  SELECT DISTINCT c.lang, array_to_string(list_slice(c.w, i, i + m - 1), ' ') AS phrase, c.a
  FROM candidates c, (SELECT unnest([1, 2, 3, 4]) AS i), (SELECT unnest([2, 3, 4]) AS m)
  WHERE i + m - 1 <= c.k AND m < c.k
),
kept AS (
  SELECT c.* FROM candidates c
  WHERE NOT EXISTS (SELECT 1 FROM longer o WHERE o.lang = c.lang AND o.phrase = c.phrase AND 100 * o.a >= 100 * c.a)
),
cuts AS (
  SELECT c.lang, c.phrase, c.a, n.n, cut, l.f AS l, r.f AS r,
         (1000::HUGEINT * c.a * n.n) // (l.f::HUGEINT * r.f) AS score
  FROM kept c
  JOIN (SELECT unnest([1, 2, 3, 4]) AS cut) ON cut < c.k
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(list_slice(c.w, 1, cut), ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(list_slice(c.w, cut + 1, c.k), ' ')
  JOIN n ON n.lang = c.lang
),
best AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS place FROM cuts
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE place = 1
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n,
       score::BIGINT AS score
FROM ranked WHERE rank <= 2000
"""
