"""Survey reports over a catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievecraft.functions import columns as C
from sievecraft.operators import aggregates as A
from sievecraft.operators import classes
from sievecraft.spec import CollectionSpec

_MB = float(C.MB)


def survey_overview(
    catalog: DataFrame, spec: CollectionSpec, mode: str = "survey", on_bad_date: str | None = None
) -> DataFrame:
    """Availability and size per class in one job; ``survey_summary`` and ``survey_size_estimate`` are views of it."""
    return overview_of(A.class_totals(classes.base(catalog, spec, mode, on_bad_date), spec))


def overview_of(totals: DataFrame) -> DataFrame:
    """The overview from class totals (class, available, avg_bytes, wanted)."""
    available, wanted = F.col("available"), F.col("wanted")
    taken = A.requested(available, wanted)
    return totals.select(
        "class",
        "available",
        taken.alias("requested"),
        A.percentage(available, wanted).alias("percentage"),
        (available < wanted).alias("short"),
        "avg_bytes",
        (F.col("avg_bytes") * taken / _MB).alias("est_total_mb"),
    )


def survey_summary(
    catalog: DataFrame, spec: CollectionSpec, mode: str = "survey", on_bad_date: str | None = None
) -> DataFrame:
    """Per class: rows available, rows that a draw would take, wanted as a share of available, and shortage."""
    return summary_of(survey_overview(catalog, spec, mode, on_bad_date))


def summary_of(overview: DataFrame) -> DataFrame:
    return overview.select("class", "available", "requested", "percentage", "short")


def survey_distribution(
    catalog: DataFrame,
    spec: CollectionSpec,
    granularity: str | None = None,
    mode: str = "survey",
    on_bad_date: str | None = None,
) -> DataFrame:
    """Rows, malware and clean rows per year, quarter or month."""
    base = classes.base(catalog, spec, mode, on_bad_date)
    return A.distribution(base, spec, granularity or spec.distribution_granularity)


def survey_size_estimate(
    catalog: DataFrame, spec: CollectionSpec, mode: str = "survey", on_bad_date: str | None = None
) -> DataFrame:
    """Mean size per class and the megabytes a draw would take, with a ``total`` row (which has no mean)."""
    return size_estimate_of(survey_overview(catalog, spec, mode, on_bad_date))


def size_estimate_of(overview: DataFrame) -> DataFrame:
    per_class = overview.select("class", "avg_bytes", "est_total_mb")
    return per_class.rollup("class").agg(
        F.when(F.grouping("class") == 0, F.max("avg_bytes")).alias("avg_bytes"),
        F.sum("est_total_mb").alias("est_total_mb"),
    ).select(F.coalesce("class", F.lit("total")).alias("class"), "avg_bytes", "est_total_mb")


def sample_size(sample: DataFrame) -> DataFrame:
    """Bytes of a drawn sample per class and overall, also in readable form."""
    return A.size_by_class(sample).withColumn("pretty", C.format_size(F.col("bytes")))
