"""The one place for intermediate tables: a folder that the driver and every executor see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession, purpose: str = "scratch") -> str:
    """The name of a new folder below ``spark.checkpoint.dir``.

    That setting must name a folder shared by all machines. Only a local session, where everything runs on one machine,
    may leave it unset: it then gets a temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="sievecraft-")
    return f"{shared.rstrip('/')}/sievecraft-{purpose}-{uuid.uuid4().hex}"


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to scratch and read back: its lineage ends there, and a lost executor costs no more than a reread."""
    spark, path = df.sparkSession, scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
