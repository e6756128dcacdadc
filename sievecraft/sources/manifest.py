"""The manifest of a table: numbered versions, each published whole and only if no other came in between.

A version is a folder of records below ``manifest``. It is written under a hidden name and renamed to the next number,
which fails where that number is taken. A writer that loses looks at what the table holds by then and settles its own
records with it: see ``settled``.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievecraft.sources.schema import MANIFEST_SCHEMA

#: Times that a writer tries to publish.
ATTEMPTS = 20

RECORD = [f for f in MANIFEST_SCHEMA.fieldNames() if f != "version"]


class ConcurrentPublishError(RuntimeError):
    """Other writers published every time."""


class Snapshot(NamedTuple):
    """What a table held when a writer began."""

    version: int
    live: DataFrame


def folder(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def latest_version(spark: SparkSession, table_dir: str) -> int:
    """The number of the last published version, 0 where there is none. One listing, no job."""
    path, store = folder(spark, f"{table_dir}/manifest")
    if not store.exists(path):
        return 0
    names = [s.getPath().getName() for s in store.listStatus(path)]
    return max((int(n.split("=")[1]) for n in names if n.startswith("version=")), default=0)


def version_files(spark: SparkSession, table_dir: str, version: int) -> tuple[str, ...]:
    """The names of a version's files, which no other version of any table shares."""
    if not version:
        return ()
    path, store = folder(spark, f"{table_dir}/manifest/version={version}")
    return tuple(sorted(s.getPath().getName() for s in store.listStatus(path)))


def renamed(spark: SparkSession, old: str, new: str) -> bool:
    """Whether the folder now has the new name; false where that is taken."""
    jvm = spark._jvm
    old_path, store = folder(spark, old)
    new_path, _ = folder(spark, new)
    option = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(old_path, new_path, options)
    except Py4JJavaError as error:
        if "FileAlreadyExists" not in error.java_exception.getClass().getName():
            raise
        store.delete(old_path, True)
        return False
    return True


def read_manifest(spark: SparkSession, table_dir: str, version: int | None = None) -> DataFrame:
    """Every record up to a version (the last one), or no rows where there is no table yet."""
    version = latest_version(spark, table_dir) if version is None else version
    if not version:
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    records = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{table_dir}/manifest")
    return records.where(F.col("version") <= version)


def live_sources(spark: SparkSession, table_dir: str, version: int | None = None) -> DataFrame:
    """The latest record of every source file, without retired ones."""
    latest = Window.partitionBy("source_path").orderBy(F.desc("version"))
    return (
        read_manifest(spark, table_dir, version)
        .where(F.col("live").isNotNull())
        .withColumn("_n", F.row_number().over(latest))
        .where((F.col("_n") == 1) & F.col("live"))
        .drop("_n")
    )


def snapshot(spark: SparkSession, table_dir: str) -> Snapshot:
    version = latest_version(spark, table_dir)
    return Snapshot(version, live_sources(spark, table_dir, version))


def settled(records: DataFrame, before: Snapshot, now: Snapshot, newer_wins: bool) -> DataFrame:
    """Records of a writer that began at ``before``, for a table that by now is at ``now``.

    A record stands where its source is as it was. Where another writer has put the source in anew or retired it, a
    retirement is dropped, and a new generation's rows are void (``live`` NULL: they are never read, and what the other
    wrote stays), unless ``newer_wins`` and they come from a later state of the file.
    """
    if now.version == before.version:
        return records
    was = before.live.select("source_path", F.col("gen").alias("_was"))
    is_now = now.live.select("source_path", F.col("gen").alias("_now"), F.col("mtime").alias("_mtime"))
    both = records.join(was, "source_path", "left").join(is_now, "source_path", "left")
    stands = F.col("_was").eqNullSafe(F.col("_now"))
    if newer_wins:
        stands = stands | (F.col("live") & F.coalesce(F.col("mtime") > F.col("_mtime"), F.lit(False)))
    return both.where(stands | F.col("live")).withColumn("live", F.when(stands, F.col("live"))).select(*RECORD)


def publish(spark: SparkSession, table_dir: str, records: DataFrame, before: Snapshot, newer_wins: bool = True) -> int:
    """Makes the records (without ``version``) the table's next version; returns its number."""
    for _ in range(ATTEMPTS):
        now = snapshot(spark, table_dir)
        hidden = f"{table_dir}/manifest/_new-{uuid.uuid4().hex}"
        settled(records.select(*RECORD), before, now, newer_wins).write.parquet(hidden)
        if renamed(spark, hidden, f"{table_dir}/manifest/version={now.version + 1}"):
            return now.version + 1
    raise ConcurrentPublishError(f"{table_dir}: {ATTEMPTS} other versions came first")
