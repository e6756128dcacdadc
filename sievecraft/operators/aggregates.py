"""Aggregates of the reports. Everything reduces on the map side to at most a few hundred groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievecraft.functions import columns as C
from sievecraft.operators.classes import cleanware_flag, malware_flag
from sievecraft.spec import CLASSES, CollectionSpec


def class_totals(base_df: DataFrame, spec: CollectionSpec) -> DataFrame:
    """One row per class: available rows and mean size, both classes from one pass over the data."""
    flags = dict(zip(CLASSES, (malware_flag(spec), cleanware_flag(spec))))
    totals = base_df.agg(
        *[F.count_if(flag).alias(f"{cls}_n") for cls, flag in flags.items()],
        *[F.avg(F.when(flag, F.col("apk_size"))).alias(f"{cls}_avg") for cls, flag in flags.items()],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(cls).alias("class"),
                F.col(f"{cls}_n").alias("available"),
                # no candidates, or none with a size: 0
                F.coalesce(F.col(f"{cls}_avg"), F.lit(0.0)).alias("avg_bytes"),
                F.lit(n).cast("bigint").alias("wanted"),
            )
            for cls, n in spec.wanted.items()
        ]
    )
    return totals.select(F.inline(rows))


def requested(available: Column, wanted: Column) -> Column:
    """What can be had of what is wanted."""
    return F.least(wanted, available)


def percentage(available: Column, wanted: Column) -> Column:
    """Wanted as a share of what is available, at most 100; 0 where nothing is."""
    share = wanted.cast("double") / available * 100.0
    return F.when(available > 0, F.least(F.lit(100.0), share)).otherwise(F.lit(0.0))


def distribution(base_df: DataFrame, spec: CollectionSpec, granularity: str) -> DataFrame:
    """Per period: rows with a key, malware, clean rows; ordered by period."""
    return (
        base_df.select(
            C.period(F.col("scan_ts"), granularity).alias("period"),
            "sha256",
            malware_flag(spec).alias("is_malware"),
            cleanware_flag(spec).alias("is_cleanware"),
        )
        .groupBy("period")
        .agg(
            F.count("sha256").alias("total"),
            F.count_if("is_malware").alias("malware"),
            F.count_if("is_cleanware").alias("cleanware"),
        )
        .orderBy("period")
    )


def with_total_row(per_class: DataFrame, *sums: str) -> DataFrame:
    """Append the overall row. The input has one row per class, so this reads a handful of rows."""
    return per_class.rollup("class").agg(*[F.sum(c).alias(c) for c in sums]).select(
        F.coalesce("class", F.lit("total")).alias("class"), *sums
    )


def _every_class(df: DataFrame) -> DataFrame:
    """Add a row of NULLs for each class that has none; one more row per class, nothing else."""
    labels = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, CLASSES))).alias("class"))
    return df.unionByName(labels, allowMissingColumns=True)


def size_by_class(rows: DataFrame) -> DataFrame:
    """Bytes per class and overall; only sizes above zero count, a missing size is nothing."""
    size = F.col("apk_size")
    per_class = (
        _every_class(rows.select("class", F.when(size > 0, size).alias("bytes")))
        .groupBy("class")
        .agg(F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("bytes"))
    )
    return with_total_row(per_class, "bytes")
