"""Rendezvous hashing of stable record keys over weighted shards, by DataFrame functions only.

Every key scores every shard, and the highest score wins: ``-weight / ln(u)`` with ``u`` a hash of key and shard. As no
score depends on the other shards, one more shard takes keys only into itself, and a heavier shard only gains keys.

Slots number the rows of a shard without gaps. Equal rows are counted before anything is shuffled, ranks are taken in
buckets of bounded size, and a running sum over the buckets' sizes gives each bucket its first slot. So no task sorts a
shard, and one row that makes up a third of the table is laid out in slices by many tasks.

Defined results: a null key is a key of its own (all rows without a key share a shard); a null text has size 1 and the
checksum of nothing; equal rows share a shard and get one slot each; an empty table gives no rows. Only the named
columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievecraft.llm.text import table
from sievecraft.scratch import staged

#: Rows that one task numbers at a time, and copies of one row that it lays out at a time.
BUCKET_ROWS, SLICE = 4096, 4096


def rendezvous(key: Column, weights: Sequence[float], first: int = 0) -> Column:
    """(score, shard) of the best shard; ``first`` is the number of the first one."""
    stable = F.coalesce(key.cast("string"), F.lit("\0null"))
    scores = []
    for shard, weight in enumerate(weights, first):
        if weight <= 0:
            continue
        # 53 bits of the hash as a number strictly between 0 and 1
        unit = (F.shiftrightunsigned(F.xxhash64(F.lit(shard), stable), 11) + 0.5) / float(1 << 53)
        scores.append(F.struct((-F.lit(float(weight)) / F.log(unit)).alias("score"), F.lit(shard).alias("shard")))
    if not scores:
        raise ValueError("no shard has a weight above 0")
    return F.array_max(F.array(*scores)) if len(scores) > 1 else scores[0]


def with_shards(df: DataFrame, key: str, weights: Sequence[float], grown_weight: float | None = None) -> DataFrame:
    """Adds ``shard``, and ``grown_shard``: where the row lies once a shard of ``grown_weight`` is added."""
    df = df.withColumn("_best", rendezvous(F.col(key), weights))
    df = df.withColumn("shard", F.col("_best.shard"))
    if grown_weight is not None:
        more = rendezvous(F.col(key), [grown_weight], len(weights))
        df = df.withColumn("_more", more).withColumn(
            "grown_shard", F.when(F.col("_more.score") > F.col("_best.score"), F.col("_more.shard")).otherwise(F.col("shard"))
        )
    return df.drop("_best", "_more")


def with_slots(rows: DataFrame, shards: int) -> DataFrame:
    """Adds ``slot``, gapless from 0 within ``shard``. ``rows`` must be narrow: all its columns are shuffled."""
    columns = rows.columns
    rows = staged(rows, "shards")
    buckets = max(1, -(-rows.count() // (BUCKET_ROWS * shards)))
    distinct = rows.groupBy(*columns).agg(F.count("*").alias("_n"))
    distinct = distinct.withColumn("_hash", F.xxhash64(*columns))
    distinct = distinct.withColumn("_bucket", F.pmod(F.col("_hash"), F.lit(buckets)))
    distinct = staged(distinct, "shard-rows")
    sizes = distinct.groupBy("shard", "_bucket").agg(F.sum("_n").alias("_size"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_bucket").orderBy("_hash", *columns).rowsBetween(Window.unboundedPreceding, -1)
    placed = distinct.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(
        starts, ["shard", "_bucket"]
    )
    placed = placed.withColumn("_first", F.col("_start") + F.col("_before"))
    few = placed.where(F.col("_n") <= SLICE).select(
        *columns, F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_n") - 1)).alias("slot")
    )
    slices = placed.where(F.col("_n") > SLICE).select(
        *columns, "_first", "_n", F.explode(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(SLICE))).alias("_from")
    )
    many = slices.repartition("_first", "_from").select(
        *columns,
        F.explode(
            F.sequence(F.col("_first") + F.col("_from"), F.col("_first") + F.least(F.col("_from") + SLICE, F.col("_n")) - 1)
        ).alias("slot"),
    )
    return few.unionByName(many)


def op8_rendezvous_shards(spark: SparkSession, sf_dir: str, shards: int = 16) -> DataFrame:
    """Shard, slot and the shard after one more is added, for every document."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(data) + 1).cast("long").alias("size"),
        F.crc32(data).cast("long").alias("text_crc32"),
    )
    rows = with_shards(rows, "doc_id", [1.0] * shards, grown_weight=1.0)
    placed = with_slots(rows, shards)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.col("grown_shard").cast("int").alias("grown_shard"),
    )
