"""Schemas of the catalogue and of its typed table."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

_LONG = {"apk_size", "vercode", "dex_size"}

# The columns of a catalogue file, in file order.
CATALOG_FIELDS = (
    "sha256", "sha1", "md5", "dex_date", "apk_size", "pkg_name", "vercode", "vt_detection", "vt_scan_date",
    "dex_size", "markets",
)

# Detections and scan date stay text here: what does not parse must become NULL, and not a broken row.
RAW_SCHEMA = T.StructType(
    [T.StructField(name, T.LongType() if name in _LONG else T.StringType()) for name in CATALOG_FIELDS]
)

# The typed table adds the parsed columns; generation and year are folders.
TABLE_SCHEMA = T.StructType(
    [
        *RAW_SCHEMA.fields,
        T.StructField("det", T.LongType()),
        T.StructField("scan_ts", T.TimestampType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("gen", T.StringType()),
        T.StructField("scan_year", T.IntegerType()),
    ]
)

MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("source_path", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("mtime", T.TimestampType()),
        T.StructField("gen", T.StringType()),
        T.StructField("n_rows", T.LongType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("converted_at", T.TimestampType()),
        # false: retired; NULL: these rows of the generation are never read
        T.StructField("live", T.BooleanType()),
        # the folder
        T.StructField("version", T.LongType()),
    ]
)

# The names under which a session can ask for UTC.
_UTC_NAMES = {"UTC", "Etc/UTC", "Z", "+00:00", "UTC+00:00", "GMT", "Etc/GMT"}


def require_utc(spark: SparkSession) -> None:
    """Scan dates are UTC wall-clock text; another session zone would store them as other instants."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in _UTC_NAMES:
        raise ValueError(f"set spark.sql.session.timeZone to UTC (it is {zone})")
