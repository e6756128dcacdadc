"""Time the product on a replicated catalogue: ``python bench_scale.py <scratch folder> [copies] [hot]``.

Every row of the 600,000-row catalogue becomes ``copies`` rows with keys of their own (38 make 22.8 million, the size
of the full public list). With ``hot`` a third of all rows are one and the same row. Prints a line per step.
"""

from __future__ import annotations

import os
import sys
import time
from dataclasses import replace

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from sievecraft.plans import collect, reports  # noqa: E402
from sievecraft.sources import catalog as source  # noqa: E402
from tests.session import make_session  # noqa: E402
from workload import adapters, registry  # noqa: E402


def main(folder: str, copies: int = 38, hot: bool = False) -> None:
    spark = make_session(os.environ.get("BENCH_CPUS", "8"))
    table_dir, store, spec = f"{folder}/table", f"{folder}/store", registry.SPEC

    def step(name, action):
        started = time.perf_counter()
        result = action()
        print(f"{name}: {time.perf_counter() - started:.1f} s {result if result is not None else ''}", flush=True)

    def run(df):
        df.write.format("noop").mode("overwrite").save()

    def make():
        rows = adapters.catalog(spark, os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")).repartition(16)
        rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(copies))))
        is_hot = (F.col("_i") % 3 == 0) if hot else F.lit(False)
        key = F.upper(F.sha2(F.concat("sha256", F.col("_i").cast("string")), 256))
        fixed = {
            "sha256": "F" * 64, "vt_detection": "45", "vt_scan_date": "1998-01-01 00:00:00", "markets": "anzhi",
            "apk_size": 1,
        }
        rows = rows.withColumns(
            {c: F.when(is_hot, F.lit(v)).otherwise(key if c == "sha256" else F.col(c)) for c, v in fixed.items()}
        )
        digest = F.when(is_hot, F.lit("0")).otherwise(F.col("sha256"))
        rows = rows.select(
            "sha256", F.substring(digest, 1, 40).alias("sha1"), F.substring(digest, 9, 32).alias("md5"),
            F.lit("1980-01-01 00:00:00").alias("dex_date"), "apk_size",
            F.concat(F.lit("com.example."), F.substring(digest, 1, 12)).alias("pkg_name"),
            F.lit(1).alias("vercode"), "vt_detection", "vt_scan_date", F.col("apk_size").alias("dex_size"), "markets",
        )
        # keep the blanks around the market
        rows.write.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(
            f"{folder}/csv"
        )

    step("make CSV", make)
    step("convert CSV to table", lambda: source.refresh_table(spark, f"{folder}/csv", table_dir).head())
    step("refresh, nothing changed", lambda: source.refresh_table(spark, f"{folder}/csv", table_dir).head())
    raw = lambda: source.read_csv(spark, f"{folder}/csv")
    table = lambda: source.read_table(spark, table_dir)
    step("year distribution from CSV", lambda: run(reports.survey_distribution(raw(), spec, "year", on_bad_date="drop")))
    step("overview from CSV", lambda: run(reports.survey_overview(raw(), spec, on_bad_date="drop")))
    step("year distribution", lambda: run(reports.survey_distribution(table(), spec, "year", on_bad_date="drop")))
    step("month distribution", lambda: run(reports.survey_distribution(table(), spec, "month", on_bad_date="drop")))
    step("overview", lambda: run(reports.survey_overview(table(), spec, on_bad_date="drop")))
    for n in (500, 50_000, 1_000_000):
        big = replace(spec, n_malware=n, n_cleanware=n)
        step(f"sample {n}", lambda: run(collect.collect_sample(table(), big)))
        if not hot:
            step(f"sample {n}, keys known unique", lambda: run(collect.collect_sample(table(), big, keys_unique=True)))
    wide = replace(spec, malware_threshold=1, n_malware=50_000)
    step("sample 50000 of most rows", lambda: run(collect.collect_sample(table(), wide)))
    step("store sample", lambda: run(collect.stored_sample(spark, table_dir, store, spec)))
    step("sample from the store", lambda: run(collect.stored_sample(spark, table_dir, store, spec)))
    step("sample from the store again", lambda: run(collect.stored_sample(spark, table_dir, store, spec)))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1], *map(int, sys.argv[2:3]), *map(bool, sys.argv[3:4]))
