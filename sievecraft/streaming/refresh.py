"""Catalogue refresh as a stream of changes to a folder of snapshot files.

A file stream sees new names only. So what changed in the folder (files added, rewritten or removed, by path, size and
modification time) is first appended to a change log, as a difference to what the log says; the stream's source is that log,
and its offsets are places in it. What a batch changes is in the table before the offset is.
"""

from __future__ import annotations

import secrets

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sievecraft.sources import catalog, manifest
from sievecraft.sources.schema import require_utc

CHANGE_SCHEMA = T.StructType(
    [
        T.StructField("source_path", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("mtime", T.TimestampType()),
        # false: the file is gone
        T.StructField("there", T.BooleanType()),
        # number of the listing that found it
        T.StructField("listing", T.LongType()),
    ]
)


def stream_id(spark: SparkSession, checkpoint_dir: str) -> str:
    """A random name kept in the checkpoint folder: a renewed checkpoint is another stream."""
    path = f"{checkpoint_dir.rstrip('/')}/sievecraft-stream"
    try:
        return spark.read.text(path).first().value
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    name = secrets.token_hex(16)
    spark.createDataFrame([(name,)], "value string").coalesce(1).write.text(path)
    return name


def latest_changes(changes: DataFrame) -> DataFrame:
    """The last change of each file."""
    last = Window.partitionBy("source_path").orderBy(F.desc("listing"))
    return changes.withColumn("_n", F.row_number().over(last)).where(F.col("_n") == 1).drop("_n")


def log_changes(spark: SparkSession, csv_dir: str, log_dir: str, files_per_part: int | None = None) -> int:
    """Appends to the log what changed in the folder since the log's last listing; returns how many files did.

    ``files_per_part`` bounds the changes in one file of the log, and so those of a stream's batch.
    """
    try:
        log = spark.read.schema(CHANGE_SCHEMA).parquet(log_dir)
        number = (log.agg(F.max("listing")).first()[0] or 0) + 1
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        log, number = spark.createDataFrame([], CHANGE_SCHEMA), 1
    known = latest_changes(log).where("there")
    listing = catalog.list_sources(spark, csv_dir)
    put = catalog.changed_sources(listing, known).select("source_path", "size", "mtime", F.lit(True).alias("there"))
    gone = known.join(listing, "source_path", "left_anti").select("source_path", "size", "mtime", F.lit(False).alias("there"))
    changes = put.unionByName(gone).withColumn("listing", F.lit(number).cast("long")).orderBy("source_path").coalesce(1)
    # file names, as many as the driver's file index holds
    rows = changes.collect()
    if rows:
        writer = spark.createDataFrame(rows, CHANGE_SCHEMA).coalesce(1).write.mode("append")
        if files_per_part:
            writer = writer.option("maxRecordsPerFile", files_per_part)
        writer.parquet(log_dir)
    return len(rows)


def apply_changes(spark: SparkSession, changes: DataFrame, csv_dir: str, table_dir: str, gen: str, csv_mode: str) -> None:
    """Puts the files of some changes into the table as generation ``gen``, and takes out those that are gone.

    A file that by now is in another state is left to the change that says so.
    """
    before = manifest.snapshot(spark, table_dir)
    last = latest_changes(changes)
    listing = catalog.list_sources(spark, csv_dir)
    here = last.where("there").join(listing.select("source_path", "size", "mtime"), ["source_path", "size", "mtime"], "left_semi")
    gone = before.live.join(last.where("not there"), "source_path", "left_semi")
    todo = here.select("source_path", "size", "mtime").collect()
    records = manifest.read_manifest(spark, table_dir, 0).select(*manifest.RECORD)
    if todo:
        raw = catalog.bound_rows(spark, [r.source_path for r in todo], csv_mode)
        catalog.write_generation(raw, table_dir, gen, sum(catalog.text_size(r.source_path, r["size"]) for r in todo))
        sources = spark.createDataFrame(todo, "source_path string, size long, mtime timestamp")
        records = catalog.records_of(sources, table_dir, gen)
    elif gone.isEmpty():
        return
    manifest.publish(spark, table_dir, records.unionByName(catalog.retired(gone)), before)


def stream_refresh(
    spark: SparkSession,
    csv_dir: str,
    table_dir: str,
    checkpoint_dir: str,
    csv_mode: str = "FAILFAST",
    max_files_per_batch: int | None = None,
) -> StreamingQuery:
    """Bring the typed table in line with what changed in the folder since this stream last looked, then stop.

    Each micro-batch becomes one generation, named after the stream's id and the batch, so a batch that runs again
    after a failure overwrites its own unpublished output and adds no row twice. A generation that the manifest lists
    is never written again. Files that another stream or refresh put into the table are not retired by this one.
    """
    require_utc(spark)
    stream = stream_id(spark, checkpoint_dir)
    log_dir = f"{checkpoint_dir.rstrip('/')}/sievecraft-changes"
    log_changes(spark, csv_dir, log_dir, max_files_per_batch)
    reader = spark.readStream.schema(CHANGE_SCHEMA)
    if max_files_per_batch:
        reader = reader.option("maxFilesPerTrigger", 1)

    def convert(batch: DataFrame, batch_id: int) -> None:
        gen = f"stream-{stream}-{batch_id:08d}"
        own = batch.sparkSession
        if not manifest.read_manifest(own, table_dir).where(F.col("gen") == gen).isEmpty():
            return
        apply_changes(own, batch, csv_dir, table_dir, gen, csv_mode)

    return (
        reader.parquet(log_dir)
        .writeStream.foreachBatch(convert)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True)
        .start()
    )
