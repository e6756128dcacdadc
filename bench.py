"""Time the headline queries: one JSON line on stdout.

``BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``) and ``BENCH_CPUS`` (default 8) choose data and cores;
``BENCH_RUNS`` (default 3) is the number of timed runs per query, of which the median counts. Every query is run
once before that. ``table_*`` queries read the typed table, ``cached_sample`` a sample in the store; making both is
timed as ``convert_csv`` and ``store_sample`` (one run each).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame  # noqa: E402

from sievecraft.plans import collect, reports  # noqa: E402
from sievecraft.sources import catalog as source  # noqa: E402
from tests.session import make_session  # noqa: E402
from workload import registry  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

HEADLINE = (
    "dist_year", "dist_quarter", "dist_month", "summary_survey", "summary_collect", "size_estimate",
    "survey_overview", "sample_union", "sample_take_all", "sample_of_copies", "sample_size_pretty", "fetch_plan",
    "file_audit", "attempt_rollup", "class_rollup",
)


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def seconds(action) -> float:
    started = time.perf_counter()
    action()
    return time.perf_counter() - started


def median(action) -> float:
    action()
    return round(statistics.median(seconds(action) for _ in range(RUNS)), 3)


def main() -> None:
    spark = make_session(CPUS)
    all_queries, spec = registry.queries(), registry.SPEC
    times = {name: median(lambda n=name: run(all_queries[n](spark, SF_DIR))) for name in HEADLINE}

    folder = tempfile.mkdtemp(prefix="sievecraft-bench-")
    table_dir, store = f"{folder}/table", f"{folder}/store"
    registry._write_csv(spark, SF_DIR, f"{folder}/csv")
    times["convert_csv"] = round(
        seconds(lambda: source.refresh_table(spark, f"{folder}/csv", table_dir).collect()), 3
    )
    table = lambda: source.read_table(spark, table_dir)
    times["table_dist_year"] = median(
        lambda: run(reports.survey_distribution(table(), spec, "year", on_bad_date="drop"))
    )
    times["table_overview"] = median(lambda: run(reports.survey_overview(table(), spec, on_bad_date="drop")))
    times["table_sample"] = median(lambda: run(collect.collect_sample(table(), spec)))
    times["table_sample_unique_keys"] = median(
        lambda: run(collect.collect_sample(table(), spec, keys_unique=True))
    )
    stored = lambda: run(collect.stored_sample(spark, table_dir, store, spec))
    times["store_sample"] = round(seconds(stored), 3)
    times["cached_sample"] = median(stored)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": int(CPUS),
                "runs": RUNS,
            }
        )
    )


if __name__ == "__main__":
    main()
