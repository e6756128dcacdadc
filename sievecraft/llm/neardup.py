"""Near-duplicate groups by SetSketch registers, confirmed on full shingle sets.

1. Every document gives its set of five-word shingles and ``REGISTERS`` registers: the smallest of as many hash values,
   taken as exponential variables, on a logarithmic scale of base ``BASE``, rounded down and truncated at both ends.
   Registers of a union are the larger ones of both, so sketches merge; equal registers are as likely as sets are alike.
2. Equal sets are one class from here on, stood for by its smallest document.
3. Bands of ``ROWS`` registers are bucket keys, as many that sets that are just alike miss every one with a probability
   below 1e-6: (1 - 0.85^5)^25 for 85 %, (1 - 0.8^5)^35 for 80 %. Within a bucket, classes whose registers agree often
   enough hang together. In a bucket of more classes than a block, each is first compared with one of them, the hub, in as
   many tasks as there are blocks; what the hub reaches is connected, and only the rest is compared with all others, in tiles
   of a block each. The components of all this are the candidate groups.
4. In a candidate group (again by way of a hub and tiles if it is large), pairs are ordered by the number of equal registers; the joint likelihood of the
   three counts (larger, smaller, equal), given both set sizes, estimates the similarity, and pairs more than 4.5 standard
   errors below the bound are left out. Each other pair whose ends are not yet connected is checked on its full sets. So
   a group of copies takes about one check for each member, and no pair is ever a row.
5. The components of the confirmed links are the result.

Defined results: null, empty and blank texts have no shingles and are linked with nothing; fewer than five words are one
shingle; rows without an id are returned with a null component and kept; rows that share an id are one node with all
their links; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecraft.llm.components import components
from sievecraft.llm.text import lower_ascii, runs, shingle_set, table, texts_of
from sievecraft.scratch import staged
from sievecraft.shipping import ship

SHINGLE, ROWS, BANDS = 5, 5, 25
REGISTERS = ROWS * BANDS
#: The most bands that a similarity may ask for; sets that are just alike miss all their bands less often than ``MISSED``.
MOST_BANDS, MISSED = 200, 1e-6
#: Base, rate and number of values of the registers.
BASE, RATE, LIMIT = 1.001, 20.0, (1 << 16) - 2
#: How far below the similarity (in standard errors) estimates still count.
ERRORS = 4.5
#: Classes in a block of a bucket, and of a candidate group.
BUCKET_BLOCK, GROUP_BLOCK = 2048, 512
FACTORS = np.random.default_rng(20240229).integers(1, 1 << 63, ROWS * MOST_BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Similarity:
    """From which Jaccard similarity on sets are alike, as a fraction of whole numbers, and what follows from it."""

    numerator: int
    denominator: int = 100

    def __post_init__(self) -> None:
        if not 0 < self.numerator <= self.denominator or self.bands > MOST_BANDS:
            raise ValueError(f"no similarity for {MOST_BANDS} bands: {self.numerator}/{self.denominator}")

    @property
    def share(self) -> float:
        return self.numerator / self.denominator

    @property
    def bands(self) -> int:
        missed = 1 - self.share**ROWS
        return max(BANDS, math.ceil(math.log(MISSED) / math.log(missed))) if missed else BANDS

    @property
    def registers(self) -> int:
        return ROWS * self.bands

    @property
    def least(self) -> float:
        return self.share - ERRORS * math.sqrt(self.share * (1 - self.share) / self.registers)

    @property
    def least_equal(self) -> int:
        return math.floor(self.least * self.registers)


#: That of op4's contract, and the one that holds where no contract names another.
OP4, GENERAL = Similarity(85), Similarity(80)


def registers_of(hashes: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """The sketch of a non-empty set of hashes."""
    factors, least = FACTORS[:registers], np.full(registers, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        np.minimum(least, (hashes[at : at + 4096, None] * factors).min(axis=0), out=least)
    value = -np.log1p(-np.minimum((least.astype(np.float64) + 0.5) / 2.0**64, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, LIMIT + 1).astype("<u2")


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


GRID = np.linspace(0, 1, 201)


def likely_similarity(
    larger: np.ndarray, smaller: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, registers: int = REGISTERS
) -> np.ndarray:
    """The most likely Jaccard similarity given how many registers of a are larger and smaller than those of b."""
    share = (size_a / (size_a + size_b))[:, None]
    limit = np.minimum(share / (1 - share), (1 - share) / share)

    def chance(x: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-12, 1)

    above, below = chance(share - (1 - share) * GRID), chance((1 - share) - share * GRID)
    same = np.clip(1 - above - below, 1e-12, 1)
    equal = (registers - larger - smaller)[:, None]
    fit = larger[:, None] * np.log(above) + smaller[:, None] * np.log(below) + equal * np.log(same)
    return GRID[np.argmax(np.where(GRID <= limit + 1e-9, fit, -np.inf), axis=1)]


def sketches(docs: DataFrame, registers_each: int) -> DataFrame:
    """doc_id, n_shingles, two hashes of the set, the registers and their low bytes."""
    ship(docs.sparkSession)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, first, second, full, low = [], [], [], [], []
            for text in texts_of(batch):
                own = shingle_set(lower_ascii(text), SHINGLE)
                sizes.append(len(own))
                first.append(int(np.bitwise_xor.reduce(own)) if len(own) else 0)
                second.append(int((own * (own | np.uint64(1))).sum(dtype=np.uint64)) if len(own) else 0)
                registers = registers_of(own, registers_each) if len(own) else np.zeros(0, "<u2")
                full.append(registers.tobytes())
                low.append((registers & 255).astype(np.uint8).tobytes())
            signed = [pa.array(np.array(v, np.uint64).view(np.int64)) for v in (first, second)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), *signed, pa.array(full, pa.binary()), pa.array(low, pa.binary())],
                ["doc_id", "n_shingles", "h1", "h2", "registers", "low"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        sketch, "doc_id long, n_shingles long, h1 long, h2 long, registers binary, low binary"
    )


def spokes(members: DataFrame, key: str, block: int) -> DataFrame:
    """Rows (key, t1, t2, hub, rep): members of large groups (key, rep, n) in blocks, each with its group's hub.

    The hub is the least member; it goes to every block of its group.
    """
    blocks = F.ceil(F.col("n") / block).cast("int")
    hubs = members.groupBy(key).agg(F.min("rep").alias("rep"), F.max("n").alias("n"))
    hubs = hubs.select(key, "rep", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("t1"), F.lit(True).alias("hub"))
    own = members.select(key, "rep", F.pmod(F.xxhash64("rep"), blocks).cast("int").alias("t1"), F.lit(False).alias("hub"))
    return own.unionByName(hubs).withColumn("t2", F.lit(-1))


def tiles(members: DataFrame, rest: DataFrame, key: str, block: int) -> DataFrame:
    """Rows (key, t1, t2, hub, rep): every block of ``rest`` (key, rep) with every block of its group's members (key, rep, n).

    ``hub`` marks the rows of ``rest``.
    """
    left = rest.groupBy(key).agg(F.ceil(F.count("*") / block).cast("int").alias("r"))
    sizes = members.groupBy(key).agg(F.max(F.ceil(F.col("n") / block)).cast("int").alias("m")).join(left, key)
    sizes = staged(sizes, "tile-numbers").hint("merge")

    def dealt(rows: DataFrame, own: str, other: str, hub: bool) -> DataFrame:
        rows = rows.select(key, "rep").join(sizes, key).withColumn("_own", F.pmod(F.xxhash64("rep"), F.col(own)).cast("int"))
        rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        t1, t2 = ("_other", "_own") if hub else ("_own", "_other")
        return rows.select(key, "rep", F.col(t1).alias("t1"), F.col(t2).alias("t2"), F.lit(hub).alias("hub"))

    return dealt(members, "m", "r", False).unionByName(dealt(rest, "r", "m", True))


def alike_groups(low: np.ndarray, least_equal: int) -> np.ndarray:
    """Labels of rows that hang together by enough equal low bytes; each row is compared with rows not yet reached."""
    label = np.full(len(low), -1)
    rest = np.arange(len(low))
    while len(rest):
        label[rest[0]], queue, rest = rest[0], [rest[0]], rest[1:]
        root = queue[0]
        while queue and len(rest):
            near = (low[rest] == low[queue.pop()]).sum(axis=1) >= least_equal
            reached = rest[near]
            label[reached] = root
            queue.extend(reached.tolist())
            rest = rest[~near]
    return label


def candidate_edges(classes: DataFrame, alike: Similarity) -> DataFrame:
    """Edges (a, b) between classes that may be alike."""
    bands = F.array(*[F.xxhash64(F.lit(i), F.substring("registers", 2 * ROWS * i + 1, 2 * ROWS)) for i in range(alike.bands)])
    keys = classes.select("rep", F.explode(bands).alias("key"))
    width, least_equal = alike.registers, alike.least_equal
    counts = staged(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "bucket-sizes")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, starts in runs(batches, ("key", "t1", "t2")):
            reps = part.column("rep").to_numpy()
            low = np.frombuffer(b"".join(part.column("low").to_pylist()), np.uint8).reshape(-1, width)
            stops = np.append(starts[1:], part.num_rows)
            two = starts[stops - starts == 2]
            two = two[(low[two] == low[two + 1]).sum(axis=1) >= least_equal]
            a, b = [reps[two]], [reps[two + 1]]
            for start, stop in zip(starts, stops):
                if stop - start > 2:
                    label = alike_groups(low[start:stop], least_equal)
                    other = np.flatnonzero(label != np.arange(len(label)))
                    a.append(reps[start + label[other]])
                    b.append(reps[start + other])
            pairs = pa.Table.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
            yield from pairs.to_batches()

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, starts in runs(batches, ("key", "t1")):
            reps, key = part.column("rep").to_numpy(), part.column("key").to_numpy()
            hub = part.column("hub").to_numpy()
            low = np.frombuffer(b"".join(part.column("low").to_pylist()), np.uint8).reshape(-1, width)
            of_hub = np.maximum.accumulate(np.where(hub, np.arange(len(hub)), 0))
            near = (low == low[of_hub]).sum(axis=1) >= least_equal
            columns = [key, reps[of_hub], reps, near]
            yield from pa.Table.from_arrays([pa.array(c[~hub]) for c in columns], ["key", "a", "b", "near"]).to_batches()

    # only classes that share a bucket need their low bytes; one plan at every size: without the hint, small tables are
    # broadcast and larger ones shuffled
    members = keys.join(counts.hint("merge"), "key")
    low = classes.select("rep", "low").hint("merge")

    def dealt(rows: DataFrame, *by: str) -> DataFrame:
        rows = rows.join(low, "rep").repartition(parts, *by)
        # the hub comes first
        return rows.select("key", "t1", "t2", "hub", "rep", "low").sortWithinPartitions(*by, F.desc("hub"))

    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    large = staged(members.where(F.col("n") > BUCKET_BLOCK), "large-buckets")
    reached = staged(
        dealt(spokes(large, "key", BUCKET_BLOCK), "key", "t1").mapInArrow(reach, "key long, a long, b long, near boolean"),
        "hub-reach",
    )
    rest = reached.where(~F.col("near")).select("key", F.col("b").alias("rep"))
    small = members.where(F.col("n") <= BUCKET_BLOCK).select(
        "key", "rep", F.lit(0).alias("t1"), F.lit(0).alias("t2"), F.lit(False).alias("hub")
    )
    rows = small.unionByName(tiles(large, rest, "key", BUCKET_BLOCK))
    edges = dealt(rows, "key", "t1", "t2").mapInArrow(compare, "a long, b long")
    return edges.unionByName(reached.where("near and a <> b").select("a", "b"))


def confirmed(
    ids: np.ndarray, sets: list[np.ndarray], registers: np.ndarray, cross: np.ndarray, alike: Similarity
) -> list[tuple[int, int]]:
    """Links that span the components of the true ones among these rows; ``cross`` tells the two blocks apart."""
    n, least, least_equal = len(ids), alike.least, alike.least_equal
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    firsts, seconds, equals = [], [], []
    for i in range(n - 1):
        j = np.arange(i + 1, n)
        j = j[np.minimum(sizes[i], sizes[j]) * alike.denominator >= alike.numerator * np.maximum(sizes[i], sizes[j])]
        if cross is not None:
            j = j[cross[j] != cross[i]]
        if not len(j):
            continue
        equal = (registers[j] == registers[i]).sum(axis=1)
        good = equal >= least_equal - ROWS
        j, equal = j[good], equal[good]
        if len(j):
            larger, smaller = (registers[i] > registers[j]).sum(axis=1), (registers[i] < registers[j]).sum(axis=1)
            good = likely_similarity(larger, smaller, np.full(len(j), sizes[i]), sizes[j], alike.registers) >= least
            firsts.append(np.full(good.sum(), i))
            seconds.append(j[good])
            equals.append(equal[good])
    if not firsts:
        return []
    first, second = np.concatenate(firsts), np.concatenate(seconds)
    order = np.argsort(-np.concatenate(equals), kind="stable")
    first, second = first[order], second[order]
    label, links = np.arange(n), []
    for at in range(0, len(first), 512):
        a, b = first[at : at + 512], second[at : at + 512]
        apart = label[a] != label[b]
        for i, j in zip(a[apart].tolist(), b[apart].tolist()):
            if label[i] == label[j]:
                continue
            common = np.intersect1d(sets[i], sets[j], assume_unique=True).size
            if alike.denominator * common >= alike.numerator * (len(sets[i]) + len(sets[j]) - common):
                label[label == label[j]] = label[i]
                links.append((int(ids[i]), int(ids[j])))
    return links


def confirmed_edges(members: DataFrame, texts: DataFrame, alike: Similarity) -> DataFrame:
    """Confirmed links (a, b) within candidate groups; ``members``: rep, component."""
    counts = staged(members.groupBy("component").agg(F.count("*").alias("n")), "group-sizes")
    members = members.join(counts.hint("merge"), "component")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, starts in runs(batches, ("component", "t1", "t2")):
            links = []
            for start, stop in zip(starts, np.append(starts[1:], part.num_rows)):
                own = part.slice(start, stop - start)
                ids = own.column("rep").to_numpy()
                sets = [shingle_set(lower_ascii(t or ""), SHINGLE) for t in own.column("text").to_pylist()]
                # rows that share an id may have other texts than their registers' one
                width = alike.registers
                registers = np.stack([registers_of(s, width) if len(s) else np.zeros(width, "<u2") for s in sets])
                side = own.column("hub").to_numpy()
                links += confirmed(ids, sets, registers, side if side.any() else None, alike)
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"]
            )

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, hubs = None, []
        for batch in batches:
            names = ("component", "t1", "hub", "rep", "text")
            out: list[list] = [[], [], [], []]
            for component, t1, is_hub, rep, text in zip(*(batch.column(c).to_pylist() for c in names)):
                own = shingle_set(lower_ascii(text or ""), SHINGLE)
                if group != (component, t1):
                    group, hubs = (component, t1), []
                if is_hub:
                    hubs.append((rep, own))
                    continue
                near = any(alike_sets(own, h, alike) for _, h in hubs)
                for column, value in zip(out, (component, hubs[0][0] if hubs else rep, rep, near)):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["component", "a", "b", "near"])

    def dealt(rows: DataFrame, *by: str) -> DataFrame:
        rows = texts.join(rows.hint("merge"), texts["doc_id"] == rows["rep"]).repartition(parts, *by)
        return rows.select("component", "t1", "t2", "hub", "rep", "text").sortWithinPartitions(*by, F.desc("hub"), "rep")

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    large = staged(members.where(F.col("n") > GROUP_BLOCK), "large-groups")
    reached = staged(
        dealt(spokes(large, "component", GROUP_BLOCK), "component", "t1").mapInArrow(
            reach, "component long, a long, b long, near boolean"
        ),
        "hub-links",
    )
    # a member with several texts (of an id that repeats) is done only if the hub has reached them all
    rest = reached.groupBy("component", F.col("b").alias("rep")).agg(F.bool_and("near").alias("near")).where("not near").drop("near")
    small = members.where(F.col("n") <= GROUP_BLOCK).select(
        "component", "rep", F.lit(0).alias("t1"), F.lit(0).alias("t2"), F.lit(False).alias("hub")
    )
    rows = small.unionByName(tiles(large, rest, "component", GROUP_BLOCK))
    links = dealt(rows, "component", "t1", "t2").mapInArrow(check, "a long, b long")
    return links.unionByName(reached.where("near and a <> b").select("a", "b"))


def alike_sets(a: np.ndarray, b: np.ndarray, alike: Similarity) -> bool:
    if not len(a) or not len(b) or min(len(a), len(b)) * alike.denominator < alike.numerator * max(len(a), len(b)):
        return False
    common = np.intersect1d(a, b, assume_unique=True).size
    return alike.denominator * common >= alike.numerator * (len(a) + len(b) - common)


def near_duplicates(docs: DataFrame, alike: Similarity = OP4) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text)."""
    rows = staged(sketches(docs, alike.registers), "sketches")
    real = rows.where("n_shingles > 0 and doc_id is not null")
    classes = real.groupBy("h1", "h2", "n_shingles").agg(
        F.min("doc_id").alias("rep"), F.min("registers").alias("registers"), F.min("low").alias("low")
    )
    classes = staged(classes, "classes")
    near = components(candidate_edges(classes, alike))
    # the texts of the members; rows that repeat an id with the same text would only be compared again
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not rows.groupBy("doc_id").count().where("count > 1 and doc_id is not null").isEmpty():
        texts = texts.dropDuplicates()
    near = near.withColumnRenamed("node", "rep")
    links = confirmed_edges(near, texts, alike)
    # an id that stands for several sets links them
    several = staged(real.join(classes.select("h1", "h2", "n_shingles", "rep"), ["h1", "h2", "n_shingles"]).select("doc_id", "n_shingles", "rep"), "members")
    mixed = several.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("top")).where("a < top").drop("top")
    mixed = several.join(mixed, "doc_id").select("a", F.col("rep").alias("b"))
    found = components(links.unionByName(mixed)).withColumnRenamed("node", "rep")
    placed = several.join(found, "rep", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id")
    )
    alone = rows.where("n_shingles = 0 or doc_id is null").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id")
    )
    groups = placed.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )
    return staged(groups, "groups")


def without_near_duplicates(docs: DataFrame, alike: Similarity = GENERAL) -> DataFrame:
    """One document of each group: the one with the smallest id; rows equal in id and text count as one document."""
    groups = near_duplicates(docs.select("doc_id", "text"), alike)
    gone = groups.where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    repeated = groups.groupBy("doc_id").count().where("count > 1 and doc_id is not null")
    if not repeated.isEmpty():
        with_id = docs.where("doc_id is not null").dropDuplicates(["doc_id", "text"])
        docs = with_id.unionByName(docs.where("doc_id is null"))
    return docs.join(gone.hint("merge"), docs["doc_id"].cast("long") == gone["_gone"], "left_anti")


def op4_setsketch_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group and kept document of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"), OP4)
