"""The Spark session of tests and bench."""

import os

from pyspark.sql import SparkSession


def make_session(cpus: str | int = 8, **conf: str) -> SparkSession:
    os.environ.setdefault("PYSPARK_PYTHON", "python")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("sievecraft")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
