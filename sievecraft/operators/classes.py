"""Base filter and class flags.

The two public commands of a curation run filter differently, and both are kept:

``collect``  needs a detection, a scan date in the window and a market, for either class.
``survey``   needs a scan date in the window only; the clean class also needs a market.

So a survey can report more malware than a collection may take.

The class is two boolean columns and not one label: with threshold 0 a row without detections is in both
classes, and a row below the threshold with some detections is in neither.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievecraft.sources.schema import require_utc
from sievecraft.functions import columns as C
from sievecraft.spec import CLEANWARE, MALWARE, CollectionSpec

MODES = ("survey", "collect")


class BadScanDateError(ValueError):
    """A survey met a scan date that does not parse."""


def with_typed_columns(catalog: DataFrame) -> DataFrame:
    """Add ``det`` and ``scan_ts`` where the catalogue still holds the raw text only."""
    require_utc(catalog.sparkSession)
    typed = {}
    if "det" not in catalog.columns:
        typed["det"] = C.parse_detection(F.col("vt_detection"))
    if "scan_ts" not in catalog.columns:
        typed["scan_ts"] = C.parse_scan_date(F.col("vt_scan_date"))
    return catalog.withColumns(typed) if typed else catalog


def in_window(catalog: DataFrame, spec: CollectionSpec) -> DataFrame:
    """Rows whose scan date lies in the closed window, with ``det`` and ``scan_ts``.

    With a typed ``scan_ts`` the bounds go to the scan, and prune year partitions where there are any. With raw text
    only, the text is compared first: a date of the right shape sorts like the time it stands for, so the bounds
    go to the scan just as well, and only rows inside them are parsed.
    """
    if "scan_ts" not in catalog.columns:
        text = F.col("vt_scan_date")
        near = catalog.where((text >= spec.date_start) & (text <= spec.date_end))
        return with_typed_columns(near).where(F.col("scan_ts").isNotNull())
    if "scan_year" in catalog.columns:
        catalog = catalog.where(F.col("scan_year").between(*spec.year_bounds))
    dtype = catalog.schema["scan_ts"].dataType
    ts = F.col("scan_ts")
    return with_typed_columns(
        catalog.where(
            (ts >= C.timestamp_like(spec.date_start, dtype)) & (ts <= C.timestamp_like(spec.date_end, dtype))
        )
    )


def check_scan_dates(catalog: DataFrame) -> None:
    """Raise if any scan date is present but does not parse.

    This is a job of its own over two columns (on a typed table over the rows without a year only), so that
    the survey's own scan keeps its pushed-down window.
    """
    df = with_typed_columns(catalog)
    bad = df.where(F.col("vt_scan_date").isNotNull() & F.col("scan_ts").isNull())
    if "scan_year" in df.columns:
        bad = bad.where(F.col("scan_year").isNull())
    first = bad.select("vt_scan_date").head()
    if first is not None:
        raise BadScanDateError(f"scan date does not parse: {first[0]!r}")


def base(
    catalog: DataFrame, spec: CollectionSpec, mode: str = "collect", on_bad_date: str | None = None
) -> DataFrame:
    """Rows that a command considers at all. ``on_bad_date`` is ``drop`` or ``fail`` (a survey's default)."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    on_bad_date = on_bad_date or ("fail" if mode == "survey" else "drop")
    if on_bad_date not in ("drop", "fail"):
        raise ValueError("on_bad_date must be 'drop' or 'fail'")
    if on_bad_date == "fail":
        check_scan_dates(catalog)
    df = in_window(catalog, spec)
    if mode == "collect":
        df = df.where(F.col("det").isNotNull() & F.col("markets").isNotNull())
    return df


def malware_flag(spec: CollectionSpec) -> Column:
    return F.coalesce(F.col("det") >= spec.malware_threshold, F.lit(False))


def cleanware_flag(spec: CollectionSpec) -> Column:
    market = F.col("markets")
    market_ok = C.is_play_market(market) if spec.google_play_only else market.isNotNull()
    return F.coalesce((F.col("det") == 0) & market_ok, F.lit(False))


def with_classes(base_df: DataFrame, spec: CollectionSpec) -> DataFrame:
    """Add ``is_malware`` and ``is_cleanware``, never NULL."""
    return base_df.withColumns({"is_malware": malware_flag(spec), "is_cleanware": cleanware_flag(spec)})


def malware(base_df: DataFrame, spec: CollectionSpec) -> DataFrame:
    return base_df.where(malware_flag(spec))


def cleanware(base_df: DataFrame, spec: CollectionSpec) -> DataFrame:
    return base_df.where(cleanware_flag(spec))


def by_class(base_df: DataFrame, spec: CollectionSpec) -> DataFrame:
    """Candidates with a ``class`` column; a row of both classes comes out twice. One scan serves both."""
    labels = F.array_compact(
        F.array(
            F.when(malware_flag(spec), F.lit(MALWARE)), F.when(cleanware_flag(spec), F.lit(CLEANWARE))
        )
    )
    return (
        base_df.where(malware_flag(spec) | cleanware_flag(spec))
        .select(F.explode(labels).alias("class"), *base_df.columns)
    )
