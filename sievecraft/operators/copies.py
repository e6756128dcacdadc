"""Numbering the rows that share a key, without ever gathering one key in one task.

A sample is drawn over rows, so two rows with the same key need two different places in the draw. Rows of a
key that occurs once get number 0 and never move. Where a key repeats, its rows are numbered 0, 1, 2, ... in the
order of a hash of their content. One key may hold a third of the table:

* rows that are equal in every column are counted before the shuffle, so a pile of identical rows travels as
  one row per task and is laid out again afterwards in slices of a fixed length;
* rows that share the key but not the content are spread over 4096 buckets by their content hash. Each
  bucket is numbered on its own and shifted by the sizes of the buckets before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievecraft.scratch import staged

# Rows that one task lays out for one pile of identical rows.
SLICE = 100_000
_BUCKET_DIGITS = 3


def key_text(key: str) -> Column:
    return F.coalesce(F.col(key), F.lit(""))


def content_text(identity: list[str]) -> Column:
    """One text for all columns that make up a row; ``~`` stands for NULL."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in identity])


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """Hashes of the keys on more than one row, with their row counts.

    Shuffles eight bytes per key, counted beforehand. A hash that two keys share is only one more key to look
    at: numbering itself goes by the key.
    """
    return (
        df.select(F.xxhash64(key_text(key)).alias("_hash"))
        .groupBy("_hash")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > 1)
    )


def split(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose key occurs once, and rows whose key repeats (None where there are none).

    One job over the key column writes the hashes of the repeated keys. Both joins with them have the same form at every
    size: Spark sends the list to every task while it is small by its own measure, and else shuffles, splitting the rows
    of a key that weighs much.
    """
    keys = staged(repeated_keys(df, key).select("_hash"), "repeated-keys")
    if keys.isEmpty():
        return df, None
    hashed = df.withColumn("_hash", F.xxhash64(key_text(key)))
    once, repeated = hashed.join(keys, "_hash", "left_anti"), hashed.join(keys, "_hash", "left_semi")
    return once.drop("_hash"), repeated.drop("_hash")


def _lay_out(piles: DataFrame, columns: list[str]) -> DataFrame:
    """One row, numbered in ``_copy``, for each of the ``_rows`` rows of a pile, from ``_first`` on.

    Piles are cut into slices that go round robin over all tasks, as one pile may make up a third of all rows. The
    number of tasks is given outright: slices are small until they are laid out, and adaptive execution would
    merge them into a task or two.
    """
    n_tasks = int(piles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = piles.select(
        *columns, "_first", "_rows", F.explode(F.sequence(F.lit(0), F.expr(f"(_rows - 1) div {SLICE}"))).alias("_slice")
    )
    low = F.col("_first") + F.col("_slice") * SLICE
    high = F.col("_first") + F.least(F.col("_slice") * SLICE + SLICE, F.col("_rows")) - 1
    return slices.repartition(n_tasks).select(*columns, F.explode(F.sequence(low, high)).alias("_copy"))


def places(repeated: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` (which hold the key) and the copy numbers that their rows have among them.

    Which row has which number does not matter here, so counting rows is enough and no other column is read.
    """
    piles = repeated.groupBy(*columns).agg(F.count(F.lit(1)).alias("_rows"))
    return _lay_out(piles.withColumn("_first", F.lit(0).cast("bigint")), columns)


def number(repeated: DataFrame, key: str, identity: list[str]) -> DataFrame:
    """Add ``_copy`` to rows that share keys."""
    columns = repeated.columns
    # sha2 counts as nullable, and a join on a nullable bucket would have every row hashed to test it for NULL
    content = F.coalesce(F.sha2(content_text(identity), 256), F.lit(""))
    piles = (
        repeated.groupBy(*columns)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumns({"_key": key_text(key), "_content": content})
        .withColumn("_bucket", F.substring("_content", 1, _BUCKET_DIGITS))
    )
    # at most 16**3 rows per key
    bucket_starts = (
        piles.groupBy("_key", "_bucket")
        .agg(F.sum("_rows").alias("_in_bucket"))
        .select(
            "_key",
            "_bucket",
            F.coalesce(
                F.sum("_in_bucket").over(
                    Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ).alias("_bucket_start"),
        )
    )
    in_bucket = (
        Window.partitionBy("_key", "_bucket")
        .orderBy("_content", *columns)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    numbered = (
        piles.withColumn("_start", F.coalesce(F.sum("_rows").over(in_bucket), F.lit(0)))
        .join(bucket_starts, ["_key", "_bucket"])
        .withColumn("_first", F.col("_start") + F.col("_bucket_start"))
    )
    return _lay_out(numbered, columns)


def one_per_key(df: DataFrame, key: str, identity: list[str]) -> DataFrame:
    """One row for each key, the one of least content hash; rows without a key are one key's.

    Rows of keys that occur once are not moved. Of a repeated key each task sends one row.
    """
    once, repeated = split(df, key)
    if repeated is None:
        return df
    columns = df.columns
    content = F.sha2(content_text(identity), 256).alias("_content")
    # in this order a tie is between rows that are equal, or differ in columns outside the identity
    least = repeated.groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(content, *columns)).alias("_row"))
    return once.unionByName(least.select(*[F.col(f"_row.{c}").alias(c) for c in columns]))
