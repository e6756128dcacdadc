"""Exact-size seeded sampling of rows without replacement.

Every candidate gets a score, a hash of the seed, its key and its copy number, and a sample is the *n* candidates of
lowest score in each class. The score does not depend on files, partitions or row order, so the same seed gives
the same sample on any cluster; a smaller sample is the first part of a larger one; and adding candidates
replaces only the rows they displace.

How it runs:

1. One narrow job counts candidates per class by the first four hex digits of the score. Partial counts are added up
   before the shuffle, and at most 2 x 65,536 rows come back.
2. Walking these counts gives, per class, the last bucket that is needed, and where each bucket starts.
3. One scan keeps the rows of needed buckets only, by a join with that small table (its size is fixed by the
   number of digits), and ranks them inside their bucket.

No task sorts the candidates, and none receives more than a bucket: about 1/65,536 of a class, however large the
sample is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievecraft.operators import copies
from sievecraft.operators.copies import key_text
from sievecraft.sources.schema import CATALOG_FIELDS

_BUCKET_DIGITS = 4


def score(seed: int, key: str) -> Column:
    """Place of a row in the draw: hex SHA-256 over ``seed:key``, with ``:copy`` from the second copy on."""
    text = F.concat(F.lit(f"{seed}:"), key_text(key))
    copy = F.col("_copy")
    place = F.sha2(F.when(copy == 0, text).otherwise(F.concat(text, F.lit(":"), copy.cast("string"))), 256)
    # Never NULL, but sha2 counts as nullable: without this, joins on it would test every row for NULL first.
    return F.coalesce(place, F.lit(""))


def _scored(rows: DataFrame, seed: int, key: str) -> DataFrame:
    return rows.withColumn("_score", score(seed, key)).withColumn(
        "_bucket", F.substring("_score", 1, _BUCKET_DIGITS)
    )


def _bucket_starts(scored: DataFrame, wanted: dict[str, int]) -> DataFrame:
    """Needed buckets per class, with the number of candidates before each (``_before``) and the class's n."""
    counts = scored.groupBy("class", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(
        Window.partitionBy("class").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    limits = F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair])
    needed = (
        counts.withColumn("_before", F.coalesce(before, F.lit(0)))
        .withColumn("_wanted", limits[F.col("class")].cast("bigint"))
        .where(F.col("_before") < F.col("_wanted"))
        .select("class", "_bucket", "_before", "_wanted")
    )
    # Bounded by the digits of the bucket: at most 16**4 rows for each class.
    return scored.sparkSession.createDataFrame(needed.toArrow(), schema=needed.schema)


def draw(
    candidates: DataFrame,
    wanted: dict[str, int],
    seed: int,
    key: str = "sha256",
    identity: list[str] | None = None,
    keys_unique: bool = False,
    keep_score: bool = False,
) -> DataFrame:
    """Draw ``wanted[class]`` rows from each class of ``candidates`` (which has a ``class`` column).

    All rows of a class come back when it has no more than that. Adds ``sample_rank``, 1..n within the class.

    ``identity`` names the columns that make up a row; they only matter where a key repeats. ``keys_unique``
    states that no key repeats within a class, as after a check with ``copies.repeated_keys``, and saves the job
    that would find out. ``keep_score`` adds each row's ``_score``.
    """
    columns = [c for c in candidates.columns if c != "class"]
    identity = identity or [c for c in CATALOG_FIELDS if c in columns] or columns
    first = F.lit(0).cast("bigint").alias("_copy")
    if keys_unique:
        once, repeated = candidates, None
    else:
        paired = candidates.withColumn("_pair", F.concat_ws(":", "class", key_text(key)))
        once, repeated = copies.split(paired, "_pair")
    places = once.select("class", key, first)
    rows = once.select("class", *columns, first)
    if repeated is not None:
        keys = repeated.select("class", key_text(key).alias(key))
        places = places.unionByName(copies.places(keys, ["class", key]))
        numbered = copies.number(repeated, "_pair", identity)
        rows = rows.unionByName(numbered.select("class", *columns, "_copy"))
    starts = _bucket_starts(_scored(places, seed, key), wanted)
    in_bucket = Window.partitionBy("class", "_bucket").orderBy("_score", *columns)
    return (
        _scored(rows, seed, key)
        .join(F.broadcast(starts), ["class", "_bucket"])
        .withColumn("_place", F.row_number().over(in_bucket))
        # no bucket gives more than the largest sample, which a task may know before it shuffles
        .where(F.col("_place") <= max(wanted.values()))
        .withColumn("sample_rank", F.col("_before") + F.col("_place"))
        .where(F.col("sample_rank") <= F.col("_wanted"))
        .select("class", "sample_rank", *columns, *(["_score"] if keep_score else []))
    )


def trim(sample: DataFrame, wanted: dict[str, int]) -> DataFrame:
    """The smaller sample inside a larger one."""
    limits = F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair])
    return sample.where(F.col("sample_rank") <= limits[F.col("class")])
