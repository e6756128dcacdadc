"""Approximate nearest neighbours by a block matrix join of int8 tiles, with exact results.

Vectors are scaled to length 1 and rounded to int8 with a factor of their own. A tile is a block of queries times a block
of candidates; its product of small integers is exact in float32. With a vector ``a = s q + e`` the product differs from
the true cosine by at most ``|e_a| + |s_a q_a| |e_b|``, so a candidate whose upper bound lies below the k-th best lower
bound of its query in the tile cannot be among the k nearest. The others are recomputed in double precision on the
original vectors, and heaps of k merge them, within the tile and then over all tiles.

Blocks meet in groups of ``C_GROUP`` candidate blocks and ``Q_GROUP`` query blocks, and every pair of groups is a task's
work of bounded size: a block is copied once for each group of the other side and not for each of its blocks. No pair of
vectors is ever a row.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do those
whose length differs from the queries' (each length is searched on its own); equal vectors tie, and ties go to the smaller
id; repeated ids are candidates each, a query's own id is none; vectors that are queries under one id share one ranking; rows without an id take no part; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievecraft.llm.text import table
from sievecraft.scratch import staged
from sievecraft.shipping import ship

#: Candidates and queries in a block, blocks of either in a group.
CANDIDATES, QUERIES, C_GROUP, Q_GROUP = 4096, 512, 8, 32


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, their factor, and the lengths of the error and of the rounded vector."""
    # the largest component first, so that no square overflows
    unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    factor = np.abs(unit).max(axis=1) / 127
    small = np.rint(unit / factor[:, None]).astype(np.int8)
    rounded = small * factor[:, None]
    return small, factor, np.linalg.norm(unit - rounded, axis=1), np.linalg.norm(rounded, axis=1)


def cosine(query: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """In double precision, by the same sums for every row, so that equal vectors get equal values."""
    # powers of two, which change no digit, keep squares from overflowing
    query = np.ldexp(query, -np.frexp(np.abs(query).max())[1])
    candidates = np.ldexp(candidates, -np.frexp(np.abs(candidates).max(axis=1, keepdims=True))[1])
    dots = (candidates * query).sum(axis=1)
    return dots / (np.sqrt((candidates * candidates).sum(axis=1)) * np.sqrt((query * query).sum()))


def nearest_in_tile(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int
) -> Iterator[tuple[int, list[tuple[float, int]]]]:
    """(query, [(score, id), ...]) of the k nearest in this block; ids equal to the query's are left out."""
    q_small, q_factor, q_error, q_length = scaled(queries)
    c_small, c_factor, c_error, c_length = scaled(vectors)
    exact = np.float32 if queries.shape[1] * 127 * 127 < 1 << 24 else np.float64
    product = q_small.astype(exact) @ c_small.astype(exact).T
    guess = product * q_factor[:, None] * c_factor
    slack = q_error[:, None] * 1.0 + q_length[:, None] * c_error[None, :] + 1e-9
    for i, query_id in enumerate(query_ids):
        other = ids != query_id
        upper, lower = guess[i] + slack[i], np.where(other, guess[i] - slack[i], -np.inf)
        if len(ids) > k:
            cut = np.partition(lower, -k)[-k]
            keep = np.flatnonzero(other & (upper >= cut))
        else:
            keep = np.flatnonzero(other)
        if len(keep):
            scores = cosine(queries[i], vectors[keep])
            yield int(query_id), heapq.nlargest(k, zip(scores.tolist(), ids[keep].tolist()), key=lambda p: (p[0], -p[1]))


def blocks(vectors: DataFrame, size: int, name: str) -> DataFrame:
    """One row for each ``size`` vectors of one length: ids and values as little-endian bytes."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def row(width: int, part: list) -> pa.RecordBatch:
            ids = np.array([i for i, _ in part], "<i8").tobytes()
            values = np.array([v for _, v in part], "<f8").tobytes()
            return pa.RecordBatch.from_arrays(
                [pa.array([width], pa.int32()), pa.array([ids], pa.binary()), pa.array([values], pa.binary())],
                ["width", f"{name}_ids", f"{name}_values"],
            )

        for batch in batches:
            for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = held.setdefault(len(vector), [])
                part.append((vec_id, vector))
                if len(part) == size:
                    yield row(len(vector), held.pop(len(vector)))
        for width, part in held.items():
            yield row(width, part)

    return vectors.mapInArrow(gather, f"width int, {name}_ids binary, {name}_values binary")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, vec_id and score of the k nearest of ``vectors`` to each row of ``queries`` (vec_id, embedding)."""
    ship(vectors.sparkSession)
    pick = (F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = usable(F.col("embedding")) & F.col("vec_id").isNotNull()
    candidates = staged(blocks(vectors.select(*pick).where(good), CANDIDATES, "c"), "candidate-blocks")
    asked = staged(blocks(queries.select(*pick).where(good).dropDuplicates(), QUERIES, "q"), "query-blocks")

    def groups(rows: DataFrame, size: int, name: str) -> DataFrame:
        """One row for each length of vectors (at most as many as a vector is long): the number of groups."""
        return rows.groupBy("width").agg(F.ceil(F.count("*") / size).cast("int").alias(name))

    numbers = staged(groups(candidates, C_GROUP, "cs").join(groups(asked, Q_GROUP, "qs"), "width"), "group-numbers")

    def dealt(rows: DataFrame, own: str, other: str, role: int, name: str) -> DataFrame:
        ids, values = f"{name}_ids", f"{name}_values"
        rows = rows.join(F.broadcast(numbers), "width").withColumn(f"{own}_at", F.pmod(F.xxhash64(ids), F.col(own)).cast("int"))
        rows = rows.withColumn(f"{other}_at", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return rows.select("width", "cs_at", "qs_at", F.lit(role).alias("role"), F.col(ids).alias("ids"), F.col(values).alias("values"))

    tiles = dealt(candidates, "cs", "qs", 0, "c").unionByName(dealt(asked, "qs", "cs", 1, "q"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("width", "cs_at", "qs_at", "role"))))
            for i, (*own, role) in enumerate(keys):
                if own != tile:
                    tile, held = own, []
                ids = np.frombuffer(batch.column("ids")[i].as_py(), "<i8")
                values = np.frombuffer(batch.column("values")[i].as_py(), "<f8").reshape(-1, own[0])
                if not role:
                    held.append((ids, values))
                elif held:
                    yield merged_nearest(ids, values, held)

    def merged_nearest(ids: np.ndarray, values: np.ndarray, held: list) -> pa.RecordBatch:
        heaps: dict[int, list] = {}
        for c_ids, c_values in held:
            for query_id, best in nearest_in_tile(ids, values, c_ids, c_values, k):
                heaps.setdefault(query_id, []).extend(best)
        rows = [
            (query_id, vec_id, score)
            for query_id, found in heaps.items()
            for score, vec_id in heapq.nlargest(k, found, key=lambda p: (p[0], -p[1]))
        ]
        kinds = (("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, (_, t) in enumerate(kinds)], [n for n, _ in kinds])

    # as many partitions as tiles, so that what a task holds does not grow with the tables
    tile_count = int(numbers.agg(F.sum(F.col("cs").cast("long") * F.col("qs"))).first()[0] or 0)
    n = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), tile_count)
    at = ("width", "cs_at", "qs_at")
    found = tiles.repartition(n, *at).sortWithinPartitions(*at, "role").mapInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_int8_block_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of all vectors to every fiftieth."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))
