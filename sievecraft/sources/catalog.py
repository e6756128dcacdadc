"""Catalogue files and their typed, partitioned Parquet table.

Layout of a table folder::

    data/gen=<generation>/scan_year=<year>/*.parquet
    manifest/version=<number>/*.parquet

A refresh converts only the files that are new or changed, all of them in one job, into a new generation folder, and
then publishes one version of the manifest (``manifest``), which adds them and retires the files that are gone. Until then
readers see the table as it was, and a refresh that fails or dies half-way takes nothing away and leaves nothing behind
that anyone reads. How many files a table has depends on years and bytes and not on the number of source files: the
source is a column, and rows of replaced sources are left out by an anti join until ``compact_table`` drops them.
"""

from __future__ import annotations

import hashlib
import math
import re
import secrets
import time
import warnings
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecraft.functions.columns import SCAN_DATE_PATTERN
from sievecraft.operators.classes import with_typed_columns
from sievecraft.sources.csv_files import bound_rows
from sievecraft.sources.manifest import (
    RECORD,
    Snapshot,
    latest_version,
    live_sources,
    publish,
    read_manifest,
    snapshot,
    version_files,
)
from sievecraft.sources.schema import CATALOG_FIELDS, RAW_SCHEMA, TABLE_SCHEMA, require_utc  # noqa: F401

# Fixed value: two modification times closer than this (in seconds) are the same.
MTIME_TOLERANCE = 0.1

# Catalogue bytes (as plain text) behind one write task, which sorts them: some 50 MB of Parquet.
TARGET_BYTES = 128 * 1024 * 1024
_SMALL_BYTES = 16 * 1024 * 1024

# Names of compressed files, and about how much text one of their bytes stands for.
COMPRESSED = r"\.(gz|bz2|deflate|zst|xz)$"
TEXT_OF_COMPRESSED = 3

# Columns of hex digits, which travel as bytes.
_HEX = ("sha256", "sha1", "md5")

# Place of a row in a table: its time in seconds above 8 bits of its task's number and 16 of its own; rows without a time
# come first.
_TASK_BITS, _ROW_BITS = 8, 16
_PLACE_BITS = _TASK_BITS + _ROW_BITS
_NEVER = -(1 << 62)


def read_csv(spark: SparkSession, paths: str | list[str], mode: str = "FAILFAST") -> DataFrame:
    """Catalogue CSV files under the fixed schema, columns by header; empty fields are NULL.

    Looks through the files' lines once, for their headers (see ``csv_files``).
    """
    return bound_rows(spark, [r.source_path for r in list_sources(spark, paths).collect()], mode).drop("source_path")


def list_sources(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Files behind ``path`` with size and modification time. Lists; opens none of them."""
    return (
        spark.read.format("binaryFile")
        .load(path)
        .select(
            F.col("_metadata.file_path").alias("source_path"),
            F.col("_metadata.file_size").alias("size"),
            F.col("_metadata.file_modification_time").alias("mtime"),
        )
    )


def source_id(path: str = "source_path"):
    return F.concat(F.lit("s"), F.sha2(F.col(path), 256))


def changed_sources(listing: DataFrame, live: DataFrame) -> DataFrame:
    """Files that the table does not hold in their present state."""
    seen = live.select(
        "source_path", F.col("size").alias("_size"), F.unix_micros("mtime").alias("_mtime")
    )
    same = (
        (listing["source_path"] == seen["source_path"])
        & (listing["size"] == seen["_size"])
        & (F.abs(F.unix_micros(listing["mtime"]) - seen["_mtime"]) <= int(MTIME_TOLERANCE * 1_000_000))
    )
    return listing.join(seen, same, "left_anti")


def is_current(spark: SparkSession, path: str, table_dir: str) -> bool:
    """Whether the table holds the files behind ``path`` as they are now, and no others."""
    live = live_sources(spark, table_dir)
    listing = list_sources(spark, path)
    gone = live.join(listing, "source_path", "left_anti")
    return changed_sources(listing, live).isEmpty() and gone.isEmpty()


def text_size(path: str, size: int) -> int:
    """About how many bytes of text a source file holds."""
    return size * (TEXT_OF_COMPRESSED if re.search(COMPRESSED, path) else 1)


def _kind(name: str) -> Column:
    """What a text is: 1 and 2 for hex digits in lower and in upper case, else 0."""
    digits = F.hex(F.unhex(name))
    return F.when(F.lower(digits) == F.col(name), 1).when(digits == F.col(name), 2).otherwise(0)


def _packed(name: str) -> Column:
    """Hex digits as half as many bytes, any other text as it is."""
    return F.when(_kind(name) > 0, F.unhex(name)).otherwise(F.col(name).cast("binary")).alias(name)


def _unpacked(name: str) -> Column:
    kind = F.shiftright("_kinds", 2 * _HEX.index(name)).bitwiseAND(3)
    text = F.when(kind == 1, F.lower(F.hex(name))).when(kind == 2, F.hex(name))
    return text.otherwise(F.col(name).cast("string")).alias(name)


def write_tasks(spark: SparkSession, n_bytes: int) -> int:
    """How many tasks write so many bytes of text.

    A task that reads rows into more shuffle partitions than Spark's ``bypassMergeThreshold`` holds them all in memory (or
    spills them), however large its file; up to that number it holds none. So up to twice the share goes to a task before
    there are more.
    """
    n = max(
        math.ceil(n_bytes / TARGET_BYTES),
        min(spark.sparkContext.defaultParallelism, math.ceil(n_bytes / _SMALL_BYTES)),
        1,
    )
    unheld = int(spark.conf.get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    return unheld if unheld < n <= 2 * unheld else n


def write_generation(raw: DataFrame, table_dir: str, gen: str, n_bytes: int) -> None:
    """Write raw rows (with ``source_path``; ``n_bytes`` as plain text) as one generation of typed, time-ordered Parquet.

    Ranges over time give every task one stretch of it, so that there are no more files than years and tasks together, and
    row groups can be skipped by time. The last bits of a row's place let a year, or a pile of equal dates (all the
    never-scanned rows), spread over as many tasks as it fills, and keep rows of one file together. Rows travel narrow: hex hashes, most of a row,
    and the source's id as bytes, time and number as one long, and no date or detections that can be told from the parsed
    ones. Zstd halves what is written.
    """
    spark = raw.sparkSession
    typed = with_typed_columns(raw.select(*CATALOG_FIELDS, "source_path"))
    text_of_time = F.date_format("scan_ts", SCAN_DATE_PATTERN)
    text_of_det = F.col("det").cast("string")
    time_bits = F.coalesce(F.shiftleft(F.unix_seconds("scan_ts"), _PLACE_BITS), F.lit(_NEVER))
    task = F.spark_partition_id().cast("long").bitwiseAND((1 << _TASK_BITS) - 1)
    row = F.monotonically_increasing_id().bitwiseAND((1 << _ROW_BITS) - 1)
    place = time_bits + F.shiftleft(task, _ROW_BITS) + row
    kinds = reduce(Column.__add__, [F.shiftleft(_kind(c), 2 * i) for i, c in enumerate(_HEX)])
    date = F.when(~F.col("vt_scan_date").eqNullSafe(text_of_time), F.col("vt_scan_date"))
    detection = F.when(~F.col("vt_detection").eqNullSafe(text_of_det), F.col("vt_detection"))
    # what is often alike in neighbouring rows stands together, and so does what never is: the last columns and, after them, the
    # first hash, where Spark puts a row's texts; the one compresses to next to nothing, and there are few changes to the other
    narrow = typed.select(
        *[_packed(c) for c in _HEX], F.unhex(F.sha2("source_path", 256)).alias("source_id"), kinds.alias("_kinds"), "dex_size",
        "vercode", "dex_date", date.alias("vt_scan_date"), "pkg_name", detection.alias("vt_detection"), "markets", "det",
        "apk_size", place.alias("_place"),
    )
    n_tasks = write_tasks(spark, n_bytes)
    time = F.when(F.col("_place") >= _NEVER // 2, F.timestamp_seconds(F.shiftright("_place", _PLACE_BITS)))
    rows = (
        narrow.repartitionByRange(n_tasks, "_place")
        .withColumn("scan_ts", time)
        .withColumn("scan_year", F.year("scan_ts"))
        .sortWithinPartitions("scan_year", "scan_ts")
        .withColumns({c: _unpacked(c) for c in _HEX})
        .withColumns(
            {
                "vt_scan_date": F.coalesce("vt_scan_date", text_of_time),
                "vt_detection": F.coalesce("vt_detection", text_of_det),
                "source_id": F.concat(F.lit("s"), F.lower(F.hex("source_id"))),
            }
        )
    )
    (
        rows.select(*CATALOG_FIELDS, "det", "scan_ts", "source_id", "scan_year")
        .write.mode("overwrite")
        .option("compression", "zstd")
        .partitionBy("scan_year")
        .parquet(f"{table_dir}/data/gen={gen}")
    )


def row_fingerprint() -> Column:
    """Aggregate over rows that does not depend on their order: two independent sums of row hashes.

    Rows count as often as they occur, and exchanging rows for others changes it.
    """
    sums = [F.sum(F.xxhash64(F.lit(seed), *CATALOG_FIELDS).cast("decimal(38, 0)")).cast("string") for seed in (1, 2)]
    return F.concat_ws(":", *sums)


def records_of(sources: DataFrame, table_dir: str, gen: str, fingerprint: bool = False) -> DataFrame:
    """Manifest records of the converted sources (path, size, mtime) of a generation.

    Reads the generation back for the number of rows, and with ``fingerprint`` for what they are.
    """
    spark = sources.sparkSession
    schema = [f for f in TABLE_SCHEMA.fields if f.name != "gen"]
    written = spark.read.schema(type(TABLE_SCHEMA)(schema)).parquet(f"{table_dir}/data/gen={gen}")
    content = [row_fingerprint().alias("content_hash")] if fingerprint else []
    counts = written.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_rows"), *content)
    if not fingerprint:
        # not a text in the aggregate: Spark would sort all rows for it
        counts = counts.withColumn("content_hash", F.lit(None).cast("string"))
    return (
        sources.withColumn("source_id", source_id())
        .join(counts, "source_id", "left")
        .select(
            "source_path",
            "source_id",
            "size",
            "mtime",
            F.lit(gen).alias("gen"),
            F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows"),
            "content_hash",
            F.current_timestamp().alias("converted_at"),
            F.lit(True).alias("live"),
        )
    )


def retired(gone: DataFrame) -> DataFrame:
    """Records that take sources out of the table."""
    return gone.withColumns({"live": F.lit(False), "converted_at": F.current_timestamp()}).select(*RECORD)


def altered_sources(spark: SparkSession, listing: DataFrame, live: DataFrame, csv_mode: str = "FAILFAST") -> DataFrame:
    """Files in their recorded size and time whose rows are not those that were converted (or were not fingerprinted).

    Reads all these files.
    """
    same = listing.join(changed_sources(listing, live), "source_path", "left_anti")
    rows = bound_rows(spark, [r.source_path for r in same.select("source_path").collect()], csv_mode)
    now = rows.groupBy("source_path").agg(row_fingerprint().alias("_now"))
    held = live.select("source_path", "content_hash", "n_rows")
    found = same.join(held, "source_path").join(now, "source_path", "left")
    empty = F.col("_now").isNull() & (F.col("n_rows") == 0)
    differs = ~F.coalesce(F.col("_now") == F.col("content_hash"), F.lit(False))
    return found.where(differs & ~empty).select(*listing.columns)


def new_generation() -> str:
    return f"{time.time_ns() // 1_000_000:013d}-{secrets.token_hex(8)}"


def refresh_table(
    spark: SparkSession,
    path: str,
    table_dir: str,
    force: bool = False,
    csv_mode: str = "FAILFAST",
    fingerprint: bool = False,
    check_content: bool = False,
) -> DataFrame:
    """Bring the table in line with the CSV files behind ``path``; returns one row (files, rows) for what was done.

    Files in their recorded state are left alone unless ``force``; files that are gone are retired. ``fingerprint`` records
    what the rows are, and ``check_content`` (which does so too) also converts files whose size and time are as recorded but
    whose rows are others. Several writers may refresh or compact one table at a time: the later state of a file wins.
    """
    require_utc(spark)
    before = snapshot(spark, table_dir)
    listing = list_sources(spark, path)
    todo = listing if force else changed_sources(listing, before.live)
    if check_content and not force:
        todo = todo.unionByName(altered_sources(spark, listing, before.live, csv_mode))
    # File names, as many as Spark's own file index holds on the driver.
    todo = todo.collect()
    gone = before.live.join(listing, "source_path", "left_anti")
    if not todo:
        if not gone.isEmpty():
            publish(spark, table_dir, retired(gone), before)
        return spark.createDataFrame([(0, 0)], "files bigint, n_rows bigint")
    gen = new_generation()
    raw = bound_rows(spark, [r.source_path for r in todo], csv_mode)
    write_generation(raw, table_dir, gen, sum(text_size(r.source_path, r.size) for r in todo))
    sources = spark.createDataFrame(todo, listing.schema)
    records = records_of(sources, table_dir, gen, fingerprint or check_content).unionByName(retired(gone))
    publish(spark, table_dir, records, before)
    return (
        read_manifest(spark, table_dir)
        .where((F.col("gen") == gen) & F.col("live"))
        .agg(F.count("*").alias("files"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"))
    )


# The files of the last version that was read of each table, which never changes, and its generations: (name, whether it
# holds rows that are not to be read).
_generations: dict[tuple[str, str], tuple[tuple[str, ...], list[tuple[str, bool]]]] = {}


def _pairs(spark: SparkSession, table_dir: str, version: int) -> DataFrame:
    """Every (gen, source_id) that was written, and whether it is what the table holds now."""
    live = live_sources(spark, table_dir, version).select("gen", "source_id", F.lit(True).alias("_live"))
    written = read_manifest(spark, table_dir, version).where("n_rows > 0").select("gen", "source_id").distinct()
    return written.join(live, ["gen", "source_id"], "left").select("gen", "source_id", F.coalesce("_live", F.lit(False)).alias("live"))


def read_table(spark: SparkSession, table_dir: str) -> DataFrame:
    """The catalogue as the manifest has it now. The manifest is read once for each version."""
    require_utc(spark)
    version = latest_version(spark, table_dir)
    key, files = (spark.sparkContext.applicationId, table_dir), version_files(spark, table_dir, version)
    if key not in _generations or _generations[key][0] != files:
        by_gen = _pairs(spark, table_dir, version).groupBy("gen").agg(F.bool_or("live").alias("any"), F.bool_and("live").alias("all"))
        _generations[key] = files, [(r.gen, not r["all"]) for r in by_gen.where("any").collect()]
    gens = _generations[key][1]
    if not gens:
        return spark.createDataFrame([], TABLE_SCHEMA)
    data = f"{table_dir}/data"
    rows = spark.read.schema(TABLE_SCHEMA).option("basePath", data).parquet(*[f"{data}/gen={g}" for g, _ in gens])
    mixed = [g for g, stale in gens if stale]
    if not mixed:
        return rows
    # sources that were replaced or retired, in generations that still hold others
    stale = _pairs(spark, table_dir, version).where(F.col("gen").isin(mixed) & ~F.col("live"))
    return rows.join(stale, ["gen", "source_id"], "left_anti").select(*TABLE_SCHEMA.fieldNames())


class Rewrite(NamedTuple):
    """A generation that holds what the table held at a snapshot."""

    gen: str
    before: Snapshot


def rewrite_table(spark: SparkSession, table_dir: str) -> Rewrite | None:
    """Writes what the table holds as one generation of full-size files, which nobody reads yet."""
    before = snapshot(spark, table_dir)
    text = F.col("size") * F.when(F.col("source_path").rlike(COMPRESSED), TEXT_OF_COMPRESSED).otherwise(1)
    total = before.live.agg(F.sum(text)).first()[0]
    if total is None:
        return None
    gen = new_generation()
    raw = read_table(spark, table_dir).join(before.live.select("source_id", "source_path"), "source_id")
    write_generation(raw.select(*CATALOG_FIELDS, "source_path"), table_dir, gen, total)
    return Rewrite(gen, before)


def publish_rewrite(spark: SparkSession, table_dir: str, rewrite: Rewrite) -> None:
    """Has the table read a rewritten generation, for every source that is as it was at the snapshot.

    A source that was refreshed or retired meanwhile stays as the other writer left it: its rewritten rows are void.
    """
    held = rewrite.before.live.select("source_path", "size", "mtime")
    records = records_of(held, table_dir, rewrite.gen)
    publish(spark, table_dir, records, rewrite.before, newer_wins=False)


def compact_table(spark: SparkSession, table_dir: str) -> str | None:
    """Rewrite what the table holds as one generation of full-size files; returns its name.

    The old generations stay on disk for readers that are still on them.
    """
    rewrite = rewrite_table(spark, table_dir)
    if rewrite is None:
        return None
    publish_rewrite(spark, table_dir, rewrite)
    return rewrite.gen


def catalog_id(spark: SparkSession, table_dir: str) -> str:
    """Identifies the table's present content: changes with every file added, changed or retired."""
    sums = [F.sum(F.xxhash64(F.lit(i), "source_id", "gen").cast("decimal(38, 0)")) for i in (1, 2)]
    row = live_sources(spark, table_dir).agg(F.count("*"), *sums).first()
    return hashlib.sha256(" ".join(str(x) for x in row).encode()).hexdigest()


def read_parquet_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A catalogue kept as plain Parquet; typed columns are added where it has none."""
    return with_typed_columns(spark.read.parquet(path))


def open_catalog(spark: SparkSession, path: str, table_dir: str | None = None) -> DataFrame:
    """A catalogue by file suffix: CSV goes through its typed table, anything else is read as Parquet."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "csv":
        table_dir = table_dir or f"{path.rstrip('/')[:-4]}.table"
        refresh_table(spark, path, table_dir)
        return read_table(spark, table_dir)
    if suffix != "parquet":
        warnings.warn(f"{path} ends in neither .csv nor .parquet, reading it as Parquet", stacklevel=2)
    return read_parquet_catalog(spark, path)
