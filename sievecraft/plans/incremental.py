"""Survey reports of a typed table that read what was added since the last report, and not the table.

A generation of a table never changes. Its summary is written once, beside it: rows, keys and sizes per source, day, number
of detections and kind of market. These cells add up. A report adds the cells of the sources that the table holds now, so a
replaced or retired source takes its cells with it; of the table itself it reads the first and the last day of the window,
where the window cuts through a day. Layout::

    <table>/survey/gen=<generation>/*.parquet

Any window, threshold, market rule and granularity can be asked of the cells.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievecraft.functions import columns as C
from sievecraft.operators import classes
from sievecraft.plans import reports
from sievecraft.sources import catalog, manifest
from sievecraft.sources.schema import require_utc
from sievecraft.spec import CLASSES, DATE_FORMAT, CollectionSpec

#: What adds up in a cell.
SUMS = ("n", "n_keys", "size_sum", "size_n")

CELLS = T.StructType(
    [
        T.StructField("source_id", T.StringType()),
        T.StructField("day", T.DateType()),
        # NULL: no detections known; above any threshold there is one value
        T.StructField("det", T.LongType()),
        # NULL: no market
        T.StructField("play", T.BooleanType()),
        *[T.StructField(c, T.DecimalType(38, 0)) for c in SUMS],
        # a scan date that is there and does not parse
        T.StructField("bad_date", T.StringType()),
        T.StructField("gen", T.StringType()),
    ]
)


def cells_of(rows: DataFrame) -> DataFrame:
    """Cells of rows of the typed table. One aggregate, partial before its shuffle; nothing but these columns is read."""
    det = F.when(F.col("det") > 100, 101).when(F.col("det") < 0, -1).otherwise(F.col("det"))
    wide = "decimal(38, 0)"
    return rows.groupBy(
        "source_id", F.to_date("scan_ts").alias("day"), det.cast("long").alias("det"),
        F.when(F.col("markets").isNotNull(), C.is_play_market(F.col("markets"))).alias("play"),
    ).agg(
        F.count(F.lit(1)).cast(wide).alias("n"),
        F.count("sha256").cast(wide).alias("n_keys"),
        F.coalesce(F.sum(F.col("apk_size").cast("decimal(19, 0)")), F.lit(0)).cast(wide).alias("size_sum"),
        F.count("apk_size").cast(wide).alias("size_n"),
        F.min(F.when(F.col("scan_ts").isNull(), F.col("vt_scan_date"))).alias("bad_date"),
    )


def summarise(spark: SparkSession, table_dir: str) -> list[str]:
    """Writes the summaries of generations that have none yet; returns their names.

    Reads these generations only. A summary appears whole, and two writers of one write the same.
    """
    require_utc(spark)
    version = manifest.latest_version(spark, table_dir)
    live = manifest.live_sources(spark, table_dir, version).where("n_rows > 0")
    gens = sorted(r.gen for r in live.select("gen").distinct().collect())
    path, store = manifest.folder(spark, f"{table_dir}/survey")
    done = {s.getPath().getName() for s in store.listStatus(path)} if store.exists(path) else set()
    new = [g for g in gens if f"gen={g}" not in done]
    for gen in new:
        rows = spark.read.schema(catalog.TABLE_SCHEMA).option("basePath", f"{table_dir}/data").parquet(f"{table_dir}/data/gen={gen}")
        hidden = f"{table_dir}/survey/_new-{uuid.uuid4().hex}"
        cells_of(rows).write.parquet(hidden)
        manifest.renamed(spark, hidden, f"{table_dir}/survey/gen={gen}")
    return new


def _midnight(day: str) -> datetime:
    return datetime.strptime(day[:10], "%Y-%m-%d")


def _whole_days(spec: CollectionSpec) -> tuple[datetime, datetime]:
    """First and last day that lie in the window as a whole (none if the first comes later)."""
    start, end = (datetime.strptime(d, DATE_FORMAT) for d in (spec.date_start, spec.date_end))
    first = _midnight(spec.date_start)
    last = _midnight(spec.date_end)
    # the last second of a day is as far as scan dates go
    return first + timedelta(days=start > first), last - timedelta(days=end < last + timedelta(hours=24, seconds=-1))


def _held_cells(spark: SparkSession, table_dir: str) -> DataFrame:
    """Cells of every source as the table holds it now."""
    summarise(spark, table_dir)
    live = manifest.live_sources(spark, table_dir).where("n_rows > 0").select("gen", "source_id")
    gens = [r.gen for r in live.select("gen").distinct().collect()]
    if not gens:
        return spark.createDataFrame([], CELLS)
    folder = f"{table_dir}/survey"
    cells = spark.read.schema(CELLS).option("basePath", folder).parquet(*[f"{folder}/gen={g}" for g in gens])
    return cells.join(live, ["gen", "source_id"], "left_semi")


def cells(
    spark: SparkSession, table_dir: str, spec: CollectionSpec, mode: str = "survey", on_bad_date: str | None = None
) -> DataFrame:
    """Cells of the rows that a command considers: see ``classes.base``."""
    on_bad_date = on_bad_date or ("fail" if mode == "survey" else "drop")
    held = _held_cells(spark, table_dir)
    if on_bad_date == "fail":
        bad = held.agg(F.min("bad_date")).first()[0]
        if bad is not None:
            raise classes.BadScanDateError(f"scan date does not parse: {bad!r}")
    first, last = _whole_days(spec)
    inner = held.where(F.col("day").between(F.lit(first.date()), F.lit(last.date())))
    # the window without its whole days
    cut = classes.in_window(catalog.read_table(spark, table_dir), spec)
    if first <= last:
        ts = F.col("scan_ts")
        cut = cut.where((ts < F.lit(first)) | (ts >= F.lit(last + timedelta(days=1))))
        whole = datetime.strptime(spec.date_start, DATE_FORMAT) == first
        if whole and datetime.strptime(spec.date_end, DATE_FORMAT) == last + timedelta(hours=24, seconds=-1):
            cut = cut.where(F.lit(False))
    out = inner.drop("gen", "bad_date").unionByName(cells_of(cut).drop("bad_date"))
    if mode == "collect":
        out = out.where("det is not null and play is not null")
    return out


def _flags(spec: CollectionSpec) -> dict[str, Column]:
    market = F.col("play") if spec.google_play_only else F.col("play").isNotNull()
    clean = (F.col("det") == 0) & F.coalesce(market, F.lit(False))
    malware = F.col("det") >= spec.malware_threshold
    return dict(zip(CLASSES, (F.coalesce(malware, F.lit(False)), F.coalesce(clean, F.lit(False)))))


def class_totals(held: DataFrame, spec: CollectionSpec) -> DataFrame:
    """What ``aggregates.class_totals`` gives, from cells."""
    sums = []
    for cls, flag in _flags(spec).items():
        sums += [F.sum(F.when(flag, F.col(c))).alias(f"{cls}_{c}") for c in ("n", "size_sum", "size_n")]
    totals = held.agg(*sums)
    rows = [
        F.struct(
            F.lit(cls).alias("class"),
            F.coalesce(F.col(f"{cls}_n"), F.lit(0)).cast("bigint").alias("available"),
            F.coalesce(F.try_divide(F.col(f"{cls}_size_sum").cast("double"), F.col(f"{cls}_size_n").cast("double")), F.lit(0.0)).alias("avg_bytes"),
            F.lit(n).cast("bigint").alias("wanted"),
        )
        for cls, n in spec.wanted.items()
    ]
    return totals.select(F.inline(F.array(*rows)))


def survey_overview(spark: SparkSession, table_dir: str, spec: CollectionSpec, mode: str = "survey", on_bad_date: str | None = None) -> DataFrame:
    """``reports.survey_overview`` of the table."""
    return reports.overview_of(class_totals(cells(spark, table_dir, spec, mode, on_bad_date), spec))


def survey_summary(spark: SparkSession, table_dir: str, spec: CollectionSpec, mode: str = "survey", on_bad_date: str | None = None) -> DataFrame:
    """``reports.survey_summary`` of the table."""
    return reports.summary_of(survey_overview(spark, table_dir, spec, mode, on_bad_date))


def survey_size_estimate(spark: SparkSession, table_dir: str, spec: CollectionSpec, mode: str = "survey", on_bad_date: str | None = None) -> DataFrame:
    """``reports.survey_size_estimate`` of the table."""
    return reports.size_estimate_of(survey_overview(spark, table_dir, spec, mode, on_bad_date))


def survey_distribution(
    spark: SparkSession,
    table_dir: str,
    spec: CollectionSpec,
    granularity: str | None = None,
    mode: str = "survey",
    on_bad_date: str | None = None,
) -> DataFrame:
    """``reports.survey_distribution`` of the table."""
    flags = _flags(spec)
    period = C.period(F.col("day"), granularity or spec.distribution_granularity)
    return (
        cells(spark, table_dir, spec, mode, on_bad_date)
        .groupBy(period.alias("period"))
        .agg(
            F.sum("n_keys").cast("bigint").alias("total"),
            *[F.coalesce(F.sum(F.when(flag, F.col("n"))), F.lit(0)).cast("bigint").alias(cls) for cls, flag in flags.items()],
        )
        .orderBy("period")
    )
