"""Catalogue CSV files, read by the names in their header lines.

Files differ: columns in another order, columns nobody knows, columns that are not there, line breaks inside quotes. One
scan of the lines finds every file's header and whether a line break lies within quotes (a line with an odd number of quote
characters opens a field that goes on). Files of one header are then read together, with a schema in their own order;
unknown columns are dropped, and absent ones are NULL. Only files with quoted line breaks are read whole by one task each.
"""

from __future__ import annotations

import csv
import re
from collections import defaultdict
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievecraft.sources.schema import CATALOG_FIELDS, RAW_SCHEMA

#: Without it a row cannot be named, drawn or fetched.
REQUIRED = "sha256"


class HeaderError(ValueError):
    """A catalogue file whose header names no key, or one column twice."""


def csv_options(mode: str = "FAILFAST") -> dict[str, str]:
    return {"header": "true", "quote": '"', "escape": '"', "mode": mode}


def literal_path(url: str) -> str:
    """The path behind a file URL as readers take it: nothing escaped by percent signs, no pattern."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", unquote(url))


def headers(spark: SparkSession, urls: list[str]) -> DataFrame:
    """source_path, header (the first line that is not blank), breaks (whether quotes hold line breaks) of each file."""
    lines = spark.read.text([literal_path(u) for u in urls]).select(
        "value",
        F.col("_metadata.file_path").alias("source_path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )
    # within a partition the lines of a block are in order
    at = F.when((F.col("_block") == 0) & (F.trim("value") != ""), F.col("_row"))
    odd = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    # a set of one value at most, and not bool_or: with a set Spark aggregates in a map of files, and without sorts all lines
    broken = F.collect_set(F.when(odd % 2 == 1, F.lit(True)))
    return lines.groupBy("source_path").agg(F.min_by("value", at).alias("header"), (F.size(broken) > 0).alias("breaks"))


def columns_of(header: str, source: str) -> tuple[str, ...]:
    """Column names of a header line; refused without the key, or with a known column twice."""
    names = tuple(next(csv.reader([header.removeprefix("﻿")])))
    if REQUIRED not in names:
        raise HeaderError(f"{source} has no column {REQUIRED}")
    for name in CATALOG_FIELDS:
        if names.count(name) > 1:
            raise HeaderError(f"{source} has column {name} more than once")
    return names


def _layout(names: tuple[str, ...]) -> T.StructType:
    known = {f.name: f.dataType for f in RAW_SCHEMA.fields}
    return T.StructType(
        [T.StructField(n if n in known else f"_unknown_{i}", known.get(n, T.StringType())) for i, n in enumerate(names)]
    )


def bound_rows(spark: SparkSession, urls: list[str], mode: str = "FAILFAST") -> DataFrame:
    """Rows of the files under the fixed schema, with ``source_path``. An empty file has none.

    Headers come to the driver, one for each file, as file names do.
    """
    groups: dict[tuple[tuple[str, ...], bool], list[str]] = defaultdict(list)
    if urls:
        for row in headers(spark, urls).collect():
            if row.header is not None:
                groups[columns_of(row.header, row.source_path), row.breaks].append(literal_path(row.source_path))
    parts = []
    for (names, breaks), paths in groups.items():
        rows = spark.read.schema(_layout(names)).options(**csv_options(mode), multiLine=breaks).csv(paths)
        fields = [
            F.col(f.name) if f.name in names else F.lit(None).cast(f.dataType).alias(f.name) for f in RAW_SCHEMA.fields
        ]
        parts.append(rows.select(*fields, F.col("_metadata.file_path").alias("source_path")))
    if not parts:
        return spark.createDataFrame([], T.StructType([*RAW_SCHEMA.fields, T.StructField("source_path", T.StringType())]))
    return reduce(DataFrame.unionByName, parts)
