"""The driver's tables seen as the product's inputs: a catalogue, an attempt log, wanted files and files on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecraft.sources import files as files_on_disk


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One catalogue row per line item; some detections, dates and markets missing or malformed."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "sha2(concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey), 256) AS sha256",
        """CASE WHEN l_linenumber = 7 THEN NULL
                WHEN l_linenumber = 6 AND l_quantity = 50 THEN 'x'
                ELSE CAST(CAST(l_quantity AS BIGINT) - 1 AS STRING) END AS vt_detection""",
        """CASE WHEN l_linenumber = 5 AND l_quantity = 50 THEN 'bad'
                ELSE date_format(l_shipdate, 'yyyy-MM-dd HH:mm:ss') END AS vt_scan_date""",
        "CASE l_returnflag WHEN 'A' THEN ' play.google.com ' WHEN 'N' THEN 'anzhi' END AS markets",
        "l_partkey * 1000 + l_suppkey AS apk_size",
    )


def catalog_with_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows under a key per supplier, so that every key repeats many times."""
    key = "sha2(CAST(l_suppkey AS STRING), 256) AS sha256"
    return table(spark, sf_dir, "lineitem").selectExpr(
        key,
        "CAST(CAST(l_quantity AS BIGINT) - 1 AS STRING) AS vt_detection",
        "date_format(l_shipdate, 'yyyy-MM-dd HH:mm:ss') AS vt_scan_date",
        "CASE l_returnflag WHEN 'A' THEN ' play.google.com ' WHEN 'N' THEN 'anzhi' END AS markets",
        # few sizes, so that some rows are equal in every column
        "CAST(l_linenumber AS BIGINT) AS apk_size",
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fetch log with one attempt per event."""
    return attempts_of(table(spark, sf_dir, "events"))


def attempts_of(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "sha2(CAST(event_id AS STRING), 256) AS sha256",
        "CASE WHEN user_id % 2 = 0 THEN 'malware' ELSE 'cleanware' END AS class",
        "1000 + event_id % 7 AS apk_size",
        "CASE WHEN event_id % 10 = 0 THEN 0 ELSE 1000 + event_id % 7 END AS bytes_downloaded",
        """CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 2000
                ELSE 1000 + event_id % 7 END AS content_length""",
        """CASE WHEN event_type = 'error' THEN 'bad'
                ELSE sha2(CAST(event_id AS STRING), 256) END AS computed_sha256""",
    )


def retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fetch log with one target per user, so that every target has many attempts."""
    return retries_of(table(spark, sf_dir, "events"))


def retries_of(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "sha2(CAST(user_id AS STRING), 256) AS sha256",
        "CASE WHEN user_id % 2 = 0 THEN 'malware' ELSE 'cleanware' END AS class",
        "CAST(value * 100 AS BIGINT) AS bytes_downloaded",
        "CAST(NULL AS BIGINT) AS content_length",
        "CASE WHEN value > 60 THEN sha2(CAST(user_id AS STRING), 256) ELSE 'bad' END AS computed_sha256",
        "CASE event_type WHEN 'error' THEN 'timeout' WHEN 'signup' THEN 'cancelled' END AS error",
    )


def retry_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan with one row per customer; most of them appear in no log."""
    return table(spark, sf_dir, "customer").selectExpr(
        "upper(sha2(CAST(c_custkey AS STRING), 256)) AS sha256",
        "CASE WHEN c_custkey % 2 = 0 THEN 'malware' ELSE 'cleanware' END AS class",
        "1000 + c_custkey AS apk_size",
    )


def repeating_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan that names each of 200 targets many times; every fifth row has no hash."""
    return table(spark, sf_dir, "customer").selectExpr(
        "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE upper(sha2(CAST(c_custkey % 200 AS STRING), 256)) END AS sha256",
        "CASE WHEN c_custkey % 2 = 0 THEN 'malware' ELSE 'cleanware' END AS class",
        "1000 + c_custkey AS apk_size",
    )


def all_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fetch log in which every outcome occurs, by the event's number."""
    kind = "event_id % 14"
    return table(spark, sf_dir, "events").selectExpr(
        f"CASE WHEN {kind} = 0 THEN NULL ELSE sha2(CAST(event_id AS STRING), 256) END AS sha256",
        "CASE WHEN user_id % 2 = 0 THEN 'malware' ELSE 'cleanware' END AS class",
        "1000 + event_id % 7 AS apk_size",
        f"CASE WHEN {kind} = 8 THEN 0 ELSE 10 END AS bytes_downloaded",
        f"CASE WHEN {kind} = 9 THEN 20 ELSE 10 END AS content_length",
        f"""CASE WHEN {kind} = 5 THEN NULL WHEN {kind} IN (10, 11) THEN 'bad'
                 ELSE sha2(CAST(event_id AS STRING), 256) END AS computed_sha256""",
        f"CASE {kind} WHEN 1 THEN 'cancelled' WHEN 2 THEN 'interrupted' WHEN 3 THEN 'timeout' WHEN 4 THEN 'request' WHEN 6 THEN 'file' WHEN 7 THEN 'odd' END AS error",
        f"{kind} IN (5, 11, 12) AS existing",
    )


def file_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file for each distinct labelled text; its name is the text's hash, or another where the quality is 0."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = table(spark, sf_dir, "documents").join(labels, "doc_id").selectExpr(
        "CASE WHEN lang = 'en' THEN 'cleanware' ELSE 'malware' END AS class",
        "sha2(concat(text, '\n'), 256) AS hash",
        "CASE WHEN quality = 0 THEN concat(text, '!') ELSE text END AS value",
    )
    # equal texts would fall into one folder, whose files are then audited together: one of them is enough
    return rows.groupBy("class", "hash").agg({"value": "min"}).withColumnRenamed("min(value)", "value")


def write_tree(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """The files of ``file_tree`` in folders by class and hash; each ends in a line break."""
    tree = file_tree(spark, sf_dir)
    if not files_on_disk.tasks_open(spark, folder):
        tree.write.partitionBy("class", "hash").text(folder)
        return
    line = F.concat(F.coalesce("value", F.lit("")), F.lit("\n")).cast("binary")
    name = F.concat_ws(
        "/", F.concat(F.lit("class="), "class"),
        F.concat(F.lit("hash="), F.coalesce("hash", F.lit("__HIVE_DEFAULT_PARTITION__"))), F.lit("part-0.txt"),
    )
    files_on_disk.write_files(tree.select(name.alias("path"), line.alias("content")), folder)


def wanted_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted files of the tree: every document that is not labelled toxic."""
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return table(spark, sf_dir, "documents").join(toxic, "doc_id", "left_anti").selectExpr(
        "CASE WHEN lang = 'en' THEN 'cleanware' ELSE 'malware' END AS class",
        "upper(sha2(concat(text, '\n'), 256)) AS sha256",
    )


def wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted files, by the hash of their text: every document that is not labelled toxic."""
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return table(spark, sf_dir, "documents").join(toxic, "doc_id", "left_anti").selectExpr(
        "CASE WHEN lang = 'en' THEN 'cleanware' ELSE 'malware' END AS class",
        "doc_id AS sample_rank",
        "upper(sha2(text, 256)) AS sha256",
        "n_chars AS apk_size",
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files on disk: every labelled document; where the quality is 0 the content is not what the name says."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return table(spark, sf_dir, "documents").join(labels, "doc_id").selectExpr(
        "CASE WHEN lang = 'en' THEN 'cleanware' ELSE 'malware' END AS class",
        "sha2(text, 256) AS sha256",
        "sha2(CASE WHEN quality = 0 THEN concat(text, '!') ELSE text END, 256) AS content_sha256",
    )


def catalog_in_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue with a package name (line breaks and quotes in those of kind 4) and ``kind``, 0 to 4."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "sha2(concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey), 256) AS sha256",
        "CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(CAST(l_quantity AS BIGINT) - 1 AS STRING) END AS vt_detection",
        "date_format(l_shipdate, 'yyyy-MM-dd HH:mm:ss') AS vt_scan_date",
        "CASE l_returnflag WHEN 'A' THEN 'play.google.com' WHEN 'N' THEN 'anzhi' END AS markets",
        "l_partkey * 1000 + l_suppkey AS apk_size",
        """concat('org.', CASE WHEN l_linenumber % 5 = 4 THEN '"a",\n b' ELSE 'a' END, l_partkey) AS pkg_name""",
        "l_linenumber % 5 AS kind",
    )


def ranked_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fetch log whose attempts name a place in a list; places repeat, and some are in no list."""
    return retries(spark, sf_dir).withColumn("sample_rank", F.conv(F.substring("sha256", 1, 3), 16, 10).cast("long"))


def ranked_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan of places, some of them twice; every eleventh row has none."""
    return table(spark, sf_dir, "customer").selectExpr(
        "CASE WHEN c_custkey % 11 > 0 THEN c_custkey % 3000 END AS sample_rank",
        "CASE WHEN c_custkey % 2 = 0 THEN 'malware' ELSE 'cleanware' END AS class",
        "1000 + c_custkey AS apk_size",
    )


def lost_tree(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Files that a listing has beside those of the tree, and that are not there: one for each German labelled text."""
    labels = table(spark, sf_dir, "labels").select("doc_id")
    rows = table(spark, sf_dir, "documents").where("lang = 'de'").join(labels, "doc_id").selectExpr(
        "'malware' AS class", "sha2(concat(text, '\n'), 256) AS sha256", "CAST(octet_length(text) AS BIGINT) AS length"
    )
    return rows.distinct().withColumn("path", F.concat(F.lit(f"{folder}/gone/"), "sha256"))
