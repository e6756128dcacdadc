"""Stored samples and hash lists.

A stored sample is keyed by everything that fixes the order of candidates and not by how many were taken, so a
smaller request is served from a larger stored sample. Layout::

    <store>/<key>/draw=<id>/class=<class>/*.json
    <store>/<key>/index/*.json        one record per draw, written last
"""

from __future__ import annotations

import json
import secrets

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievecraft.operators.sampling import trim
from sievecraft.scratch import staged
from sievecraft.spec import CLASSES, CollectionSpec

INDEX_SCHEMA = T.StructType(
    [
        T.StructField("draw", T.StringType()),
        T.StructField("sample_schema", T.StringType()),
        T.StructField("written_at", T.TimestampType()),
        *[T.StructField(f"{c}_wanted", T.LongType()) for c in CLASSES],
        *[T.StructField(f"{c}_n", T.LongType()) for c in CLASSES],
        *[T.StructField(f"{c}_hash", T.LongType()) for c in CLASSES],
        T.StructField("seed", T.LongType()),
    ]
)


def _summary(rows: DataFrame) -> DataFrame:
    """Rows of each class and a hash of all their columns: reading it reads every field of every record."""
    row_hash = F.xxhash64(*[F.to_json(F.struct(c)) for c in rows.columns])
    return rows.agg(
        *[F.count_if(F.col("class") == c).alias(f"{c}_n") for c in CLASSES],
        *[F.coalesce(F.bit_xor(F.when(F.col("class") == c, row_hash)), F.lit(0)).alias(f"{c}_hash") for c in CLASSES],
    )


def write_sample(
    sample: DataFrame, store: str, key: str, wanted: dict[str, int], seed: int | None = None
) -> None:
    """Store a sample as JSON Lines per class, with the seed that drew it. The index record that makes it visible comes last."""
    spark = sample.sparkSession
    draw = secrets.token_hex(8)
    folder = f"{store}/{key}/draw={draw}"
    sample.write.partitionBy("class").json(folder)
    stored = spark.read.schema(sample.schema).option("mode", "FAILFAST").json(folder)
    record = _summary(stored).withColumns(
        {
            "seed": F.lit(seed).cast("bigint"),
            "draw": F.lit(draw),
            "sample_schema": F.lit(sample.schema.json()),
            "written_at": F.current_timestamp(),
            **{f"{c}_wanted": F.lit(wanted[c]).cast("bigint") for c in CLASSES},
        }
    )
    record.select(*INDEX_SCHEMA.fieldNames()).write.mode("append").json(f"{store}/{key}/index")


def _serves(wanted: dict[str, int]):
    """A draw serves a request it was made for, a smaller one, or any once it holds every candidate."""
    checks = [
        (F.col(f"{c}_wanted") >= n) | (F.col(f"{c}_n") < F.col(f"{c}_wanted")) for c, n in wanted.items()
    ]
    return checks[0] & checks[1]


def read_sample(spark: SparkSession, store: str, key: str, wanted: dict[str, int]) -> DataFrame | None:
    """The stored sample trimmed to ``wanted``, or None: nothing stored, too small, or not whole any more."""
    try:
        index = spark.read.schema(INDEX_SCHEMA).json(f"{store}/{key}/index")
        hit = index.where(_serves(wanted)).orderBy(F.desc("written_at"), "draw").head()
        if hit is None:
            return None
        schema = T.StructType.fromJson(json.loads(hit.sample_schema))
        stored = (
            spark.read.schema(schema).option("mode", "FAILFAST").json(f"{store}/{key}/draw={hit.draw}")
        )
        # A record that is damaged in any field fails here or changes the hash, and makes the whole draw a miss.
        found = _summary(stored).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    except (PySparkException, Py4JJavaError) as error:
        if "MALFORMED_RECORD" not in str(error):
            raise
        return None
    if any(found[f"{c}_{x}"] != hit[f"{c}_{x}"] for c in CLASSES for x in ("n", "hash")):
        return None
    return trim(stored, wanted)


def stored_or_drawn(
    spark: SparkSession, store: str, spec: CollectionSpec, key: str, draw, force: bool = False
) -> DataFrame:
    """The stored sample for a key, or ``draw()`` stored and read back."""
    sample = None if force else read_sample(spark, store, key, spec.wanted)
    if sample is None:
        write_sample(draw(), store, key, spec.wanted, spec.random_seed)
        sample = read_sample(spark, store, key, spec.wanted)
    return sample


def drawn_seeds(spark: SparkSession, store: str) -> DataFrame:
    """key, draw, seed and time of every stored draw."""
    index = spark.read.schema(INDEX_SCHEMA).json(f"{store}/*/index")
    key = F.regexp_extract("_metadata.file_path", r"/([^/]+)/index/[^/]+$", 1)
    return index.select(key.alias("key"), "draw", "seed", "written_at")


def export_hashes(sample: DataFrame, out_dir: str, write_empty: bool = False, one_file: bool = False) -> list[str]:
    """Write each class's hashes, one per line in sample order and catalogue letter case; returns the folders.

    A class without rows gets a folder only with ``write_empty``. ``one_file`` writes through one task. The sample is
    evaluated once.
    """
    written = []
    sample = staged(sample.select("class", "sample_rank", "sha256"), "hash-lists")
    for cls in CLASSES:
        rows = sample.where(F.col("class") == cls)
        if not write_empty and rows.isEmpty():
            continue
        lines = rows.select("sample_rank", F.coalesce("sha256", F.lit("")).alias("sha256"))
        lines = (
            lines.repartition(1).sortWithinPartitions("sample_rank") if one_file else lines.orderBy("sample_rank")
        )
        lines.select("sha256").write.mode("overwrite").text(f"{out_dir}/{cls}.txt")
        written.append(f"{out_dir}/{cls}.txt")
    return written
