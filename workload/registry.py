"""Every operator as a query over the driver's tables. Each calls the operator that users call."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecraft.functions import columns as C
from sievecraft.operators import classes, fetch, sampling
from sievecraft.plans import collect, incremental, reports, summaries
from sievecraft.scratch import scratch_dir
from sievecraft.sources import catalog as source
from sievecraft.sources import files, manifest, sample_store
from sievecraft.spec import CollectionSpec
from sievecraft.streaming.refresh import stream_refresh
from sievecraft.streaming.rollup import keep_totals, live_attempts, live_rollup, live_targets, totals_of, verdict_changes
from workload import adapters

Query = Callable[[SparkSession, str], DataFrame]

SPEC = CollectionSpec(
    date_start="1996-01-01 00:00:00",
    date_end="2000-12-31 23:59:59",
    malware_threshold=40,
    n_malware=500,
    n_cleanware=100,
)
THRESHOLD_0 = replace(SPEC, malware_threshold=0)
ALL_MARKETS = replace(SPEC, google_play_only=False)
# More than there is of the clean class, and less than there is of the other.
SHORT = replace(SPEC, n_malware=2000, n_cleanware=1_000_000)
# A window after the last scan.
LATER = replace(SPEC, date_start="2030-01-01 00:00:00", date_end="2031-01-01 00:00:00")
# A window that cuts through its first and its last day; dates are midnights.
CUT = replace(SPEC, date_start="1996-03-01 12:00:00", date_end="1999-07-04 00:00:00")
SMALLER = replace(SPEC, n_malware=120, n_cleanware=30)


def _plain(df: DataFrame) -> DataFrame:
    """Scan time as text: a report holds no time-zone-aware values."""
    return df.withColumn("scan_ts", F.date_format("scan_ts", C.SCAN_DATE_PATTERN))


def _distribution(granularity: str, spec: CollectionSpec = SPEC) -> Query:
    return lambda spark, sf: reports.survey_distribution(
        adapters.catalog(spark, sf), spec, granularity, on_bad_date="drop"
    )


def _summary(spec: CollectionSpec, mode: str) -> Query:
    return lambda spark, sf: reports.survey_summary(adapters.catalog(spark, sf), spec, mode, on_bad_date="drop")


def size_estimate(spark: SparkSession, sf: str) -> DataFrame:
    sizes = reports.survey_size_estimate(adapters.catalog(spark, sf), SPEC, on_bad_date="drop")
    return sizes.select(
        "class", F.round("avg_bytes", 4).alias("avg_bytes"), F.round("est_total_mb", 4).alias("est_total_mb")
    )


def survey_overview(spark: SparkSession, sf: str) -> DataFrame:
    df = reports.survey_overview(adapters.catalog(spark, sf), SHORT, on_bad_date="drop")
    return df.withColumns(
        {"avg_bytes": F.round("avg_bytes", 4), "est_total_mb": F.round("est_total_mb", 4)}
    )


def _base(mode: str) -> Query:
    return lambda spark, sf: _plain(
        classes.base(adapters.catalog(spark, sf), SPEC, mode, on_bad_date="drop")
    )


def class_flags(spark: SparkSession, sf: str) -> DataFrame:
    base = classes.base(adapters.catalog(spark, sf), THRESHOLD_0, "survey", on_bad_date="drop")
    return classes.with_classes(base, THRESHOLD_0).select("sha256", "det", "is_malware", "is_cleanware")


def malware_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(classes.malware(classes.base(adapters.catalog(spark, sf), SPEC), SPEC))


def cleanware_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(classes.cleanware(classes.base(adapters.catalog(spark, sf), SPEC), SPEC))


def both_classes(spark: SparkSession, sf: str) -> DataFrame:
    rows = collect.candidates(adapters.catalog(spark, sf), THRESHOLD_0)
    return rows.groupBy("class").agg(F.count("*").alias("n"), F.sum("apk_size").alias("bytes"))


def scalar_columns(spark: SparkSession, sf: str) -> DataFrame:
    df = classes.with_typed_columns(adapters.catalog(spark, sf))
    ts = F.col("scan_ts")
    return df.select(
        "sha256",
        "det",
        F.date_format(ts, C.SCAN_DATE_PATTERN).alias("scan_text"),
        C.trimmed_market(F.col("markets")).alias("market"),
        C.period(ts, "year").alias("period_year"),
        C.period(ts, "quarter").alias("period_quarter"),
        C.period(ts, "month").alias("period_month"),
        C.format_size(F.col("apk_size")).alias("pretty"),
        C.target_path(F.lit("malware"), F.upper("sha256")).alias("path"),
        C.is_play_market(F.col("markets")).alias("is_play"),
    )


def lenient_predicates(spark: SparkSession, sf: str) -> DataFrame:
    raw = adapters.catalog(spark, sf)
    detection, date = F.col("vt_detection"), F.col("vt_scan_date")
    return raw.agg(
        F.count_if(C.has_detection(detection)).alias("has_detection"),
        F.count_if(C.is_malware_lenient(detection, SPEC.malware_threshold)).alias("is_malware"),
        F.count_if(C.is_within_date_range(date, SPEC.date_start, SPEC.date_end)).alias("in_range"),
    )


def parse_edge(spark: SparkSession, sf: str) -> DataFrame:
    raw = adapters.catalog(spark, sf)
    detection, date = F.col("vt_detection"), F.col("vt_scan_date")
    return raw.agg(
        F.count_if(detection.isNotNull() & C.parse_detection(detection).isNull()).alias("bad_detections"),
        F.count_if(date.isNotNull() & C.parse_scan_date(date).isNull()).alias("bad_dates"),
        F.count_if(detection.isNull()).alias("no_detection"),
        F.count_if(F.col("markets").isNull()).alias("no_market"),
    )


def _sample(spark: SparkSession, sf: str, spec: CollectionSpec = SPEC, mode: str = "collect") -> DataFrame:
    return collect.collect_sample(adapters.catalog(spark, sf), spec, mode, on_bad_date="drop")


def sample_malware(spark: SparkSession, sf: str) -> DataFrame:
    base = classes.base(adapters.catalog(spark, sf), SPEC)
    rows = classes.malware(base, SPEC).withColumn("class", F.lit("malware"))
    return _plain(sampling.draw(rows, {"malware": SPEC.n_malware}, SPEC.random_seed))


def sample_cleanware(spark: SparkSession, sf: str) -> DataFrame:
    base = classes.base(adapters.catalog(spark, sf), SPEC)
    rows = classes.cleanware(base, SPEC).withColumn("class", F.lit("cleanware"))
    return _plain(sampling.draw(rows, {"cleanware": SPEC.n_cleanware}, SPEC.random_seed))


def sample_union(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(_sample(spark, sf))


def sample_survey(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(_sample(spark, sf, mode="survey"))


def sample_take_all(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(_sample(spark, sf, SHORT))


def sample_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(_sample(spark, sf, THRESHOLD_0))


def sample_trim(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(sampling.trim(_sample(spark, sf), SMALLER.wanted))


def sample_of_copies(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(collect.collect_sample(adapters.catalog_with_copies(spark, sf), SHORT))


def sample_size_pretty(spark: SparkSession, sf: str) -> DataFrame:
    return reports.sample_size(_sample(spark, sf))


def work_list(spark: SparkSession, sf: str) -> DataFrame:
    return fetch.work_list(sample_cleanware(spark, sf), sample_malware(spark, sf)).select(
        "class", "sample_rank", "sha256"
    )


def _fetch_plan(verify: bool) -> Query:
    return lambda spark, sf: fetch.fetch_plan(adapters.wanted(spark, sf), adapters.files(spark, sf), verify)


def planned_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return fetch.planned_bytes(_fetch_plan(True)(spark, sf))


def file_audit(spark: SparkSession, sf: str) -> DataFrame:
    return fetch.audit_files(adapters.wanted(spark, sf), adapters.files(spark, sf))


def audit_summary(spark: SparkSession, sf: str) -> DataFrame:
    return fetch.audit_summary(file_audit(spark, sf))


def attempt_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return fetch.classify_attempts(adapters.attempts(spark, sf)).select("class", "sha256", "outcome")


def outcome_counts(spark: SparkSession, sf: str) -> DataFrame:
    return fetch.outcome_counts(fetch.classify_attempts(adapters.attempts(spark, sf)))


def class_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return fetch.class_rollup(fetch.classify_attempts(adapters.attempts(spark, sf)))


def paired_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    log = fetch.classify_attempts(adapters.retries(spark, sf))
    return fetch.pair_outcomes(log, adapters.retry_plan(spark, sf)).drop("plan_rows", "plan_bytes")


def attempt_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return fetch.attempt_rollup(adapters.retries(spark, sf), adapters.retry_plan(spark, sf))


def run_verdict(spark: SparkSession, sf: str) -> DataFrame:
    attempts = fetch.classify_attempts(adapters.retries(spark, sf))
    return fetch.run_verdict(attempt_rollup(spark, sf), attempts, adapters.retry_plan(spark, sf))


def rollup_repeated_keys(spark: SparkSession, sf: str) -> DataFrame:
    """A plan that names targets many times and has rows without a hash."""
    return fetch.attempt_rollup(adapters.retries(spark, sf), adapters.repeating_plan(spark, sf))


def outcome_labels(spark: SparkSession, sf: str) -> DataFrame:
    """All thirteen outcomes."""
    return fetch.outcome_counts(fetch.classify_attempts(adapters.all_attempts(spark, sf)))


def survey_bad_date(spark: SparkSession, sf: str) -> DataFrame:
    """What a survey's default mode does with the table's malformed dates, and with a table that has none."""
    raw = adapters.catalog(spark, sf)
    good = raw.where("vt_scan_date <> 'bad'")
    steps = []
    for name, table in (("as_is", raw), ("good_dates", good)):
        try:
            n = classes.base(table, SPEC, "survey").agg(F.count("scan_ts").alias("n")).first().n
            steps.append((name, "rows", n))
        except ValueError:
            steps.append((name, "failed", 0))
    return spark.createDataFrame(steps, "step string, result string, n_rows bigint")


def _write_csv(spark: SparkSession, sf: str, folder: str) -> None:
    raw = adapters.catalog(spark, sf)
    missing = [f for f in source.RAW_SCHEMA.fields if f.name not in raw.columns]
    raw = raw.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing})
    raw.select(*source.CATALOG_FIELDS).write.option("header", True).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).option("compression", "gzip").csv(folder)


def typed_table(spark: SparkSession, sf: str) -> DataFrame:
    """CSV files, converted to the typed table, read back through it."""
    folder = scratch_dir(spark)
    _write_csv(spark, sf, f"{folder}/csv")
    source.refresh_table(spark, f"{folder}/csv", f"{folder}/table")
    return reports.survey_distribution(
        source.read_table(spark, f"{folder}/table"), SPEC, "month", on_bad_date="drop"
    )


def refresh_twice(spark: SparkSession, sf: str) -> DataFrame:
    """Rows converted by a first refresh, by a second one, and rows in the table after both."""
    folder = scratch_dir(spark)
    _write_csv(spark, sf, f"{folder}/csv")
    done = [source.refresh_table(spark, f"{folder}/csv", f"{folder}/table") for _ in range(2)]
    table = source.read_table(spark, f"{folder}/table").agg(F.count("*").alias("n_rows"))
    steps = {"first": done[0], "second": done[1], "table": table}
    rows = [df.select(F.lit(step).alias("step"), "n_rows") for step, df in steps.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def streamed_table(spark: SparkSession, sf: str) -> DataFrame:
    """The same table filled by the file stream, run twice: the second run adds nothing."""
    folder = scratch_dir(spark)
    _write_csv(spark, sf, f"{folder}/csv")
    for _ in range(2):
        stream_refresh(spark, f"{folder}/csv", f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return reports.survey_distribution(
        source.read_table(spark, f"{folder}/table"), SPEC, "year", on_bad_date="drop"
    )


def stored_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A sample written to the store and a smaller request served from it."""
    folder = scratch_dir(spark)
    key = SPEC.fingerprint(sf, "collect")
    sample_store.write_sample(_sample(spark, sf), f"{folder}/store", key, SPEC.wanted)
    return _plain(sample_store.read_sample(spark, f"{folder}/store", key, SMALLER.wanted))


def stored_sample_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """Samples kept under the real key: the same request again, one that must not be served from it, one without a seed."""
    folder = scratch_dir(spark)
    _write_csv(spark, sf, f"{folder}/csv")
    source.refresh_table(spark, f"{folder}/csv", f"{folder}/table")
    ask = lambda spec, **how: collect.stored_sample(spark, f"{folder}/table", f"{folder}/store", spec, **how)
    steps = {
        "first": ask(SPEC), "smaller": ask(SMALLER), "unique": ask(SPEC, keys_unique=True),
        "unseeded": ask(replace(SPEC, random_seed=None)),
    }
    seeds = sample_store.drawn_seeds(spark, f"{folder}/store")
    rows = [df.groupBy("class").agg(F.count("*").alias("n")).withColumn("step", F.lit(k)) for k, df in steps.items()]
    rows.append(seeds.agg(F.lit("draws").alias("class"), F.count("seed").alias("n"), F.lit("store").alias("step")))
    return reduce(DataFrame.unionByName, rows)


def store_damaged(spark: SparkSession, sf: str) -> DataFrame:
    """A stored sample with one damaged number is drawn anew and equals the sample."""
    folder = scratch_dir(spark)
    key = SPEC.fingerprint(sf, "collect")
    store = f"{folder}/store"
    sample_store.write_sample(_sample(spark, sf), store, key, SPEC.wanted, SPEC.random_seed)
    lines = spark.read.text(f"{store}/{key}/draw=*/class=malware")
    broken = F.regexp_replace("value", r'"sample_rank":1,(.*)"apk_size":\d+', r'"sample_rank":1,$1"apk_size":"x"')
    index = spark.read.schema(sample_store.INDEX_SCHEMA).json(f"{store}/{key}/index").first()
    copy = f"{folder}/damaged"
    for cls in SPEC.wanted:
        rows = lines.select(broken) if cls == "malware" else spark.read.text(f"{store}/{key}/draw=*/class={cls}")
        rows.write.text(f"{copy}/{key}/draw={index.draw}/class={cls}")
    spark.createDataFrame([index], sample_store.INDEX_SCHEMA).write.json(f"{copy}/{key}/index")
    served = sample_store.read_sample(spark, copy, key, SMALLER.wanted)
    if served is not None:
        return served
    redrawn = sample_store.stored_or_drawn(spark, copy, SPEC, key, lambda: _sample(spark, sf))
    return _plain(sampling.trim(redrawn, SMALLER.wanted))


def _split_csv(spark: SparkSession, sf: str, folder: str, where: str) -> None:
    raw = adapters.catalog(spark, sf).where(where)
    missing = [f for f in source.RAW_SCHEMA.fields if f.name not in raw.columns]
    raw = raw.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing})
    raw.select(*source.CATALOG_FIELDS).write.mode("overwrite").option("header", True).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).option("compression", "gzip").csv(folder)


def refresh_replaced(spark: SparkSession, sf: str) -> DataFrame:
    """Two sources; one is then renamed and the other replaced by other rows: what the table holds before and after."""
    folder, table = scratch_dir(spark), "table"
    for name, where in (("a/one", "apk_size % 2 = 0"), ("a/two", "apk_size % 2 = 1"), ("b/two", "apk_size % 4 = 1")):
        _split_csv(spark, sf, f"{folder}/{name}", where)
    rows = []
    for step in ("a", "b"):
        if step == "b" and not manifest.renamed(spark, f"{folder}/a/one", f"{folder}/b/renamed"):
            raise ValueError("the new name is taken")
        source.refresh_table(spark, f"{folder}/{step}/*", f"{folder}/{table}")
        rows.append(_held(spark, f"{folder}/{table}", step))
    source.compact_table(spark, f"{folder}/{table}")
    rows.append(_held(spark, f"{folder}/{table}", "compacted"))
    return reduce(DataFrame.unionByName, rows)


def _held(spark: SparkSession, table: str, step: str) -> DataFrame:
    size = F.coalesce(F.sum("apk_size"), F.lit(0)).alias("bytes")
    return source.read_table(spark, table).agg(F.lit(step).alias("step"), F.count("*").alias("n_rows"), size)


def refresh_failed(spark: SparkSession, sf: str) -> DataFrame:
    """A source is replaced by one that does not convert: the refresh fails and the table holds what it held."""
    folder = scratch_dir(spark)
    _split_csv(spark, sf, f"{folder}/good", "true")
    source.refresh_table(spark, f"{folder}/good", f"{folder}/table")
    head = spark.createDataFrame([(",".join(source.CATALOG_FIELDS),)], "value string")
    head.coalesce(1).unionByName(spark.createDataFrame([("a,b,c,d,no number,,,,,,",)], "value string")).coalesce(
        1
    ).write.text(f"{folder}/broken")
    try:
        source.refresh_table(spark, f"{folder}/broken", f"{folder}/table")
        step = "accepted"
    except (PySparkException, Py4JJavaError):
        step = "refused"
    return _held(spark, f"{folder}/table", step)


def stream_new_checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    """A stream goes on with a renewed checkpoint over a folder of other files: both runs' rows stay."""
    folder = scratch_dir(spark)
    for name, where in (("a", "apk_size % 2 = 0"), ("b", "apk_size % 2 = 1")):
        _split_csv(spark, sf, f"{folder}/{name}", where)
        # the same place in the table; a lost checkpoint begins again at batch 0
        stream_refresh(spark, f"{folder}/{name}", f"{folder}/table", f"{folder}/check-{name}/c").awaitTermination()
    return _held(spark, f"{folder}/table", "both")


def open_by_suffix(spark: SparkSession, sf: str) -> DataFrame:
    """The same catalogue opened as CSV and as Parquet."""
    folder = scratch_dir(spark)
    _write_csv(spark, sf, f"{folder}/catalogue.csv")
    adapters.catalog(spark, sf).write.parquet(f"{folder}/catalogue.parquet")
    rows = []
    for suffix in ("csv", "parquet"):
        table = source.open_catalog(spark, f"{folder}/catalogue.{suffix}")
        rows.append(table.agg(F.lit(suffix).alias("suffix"), F.count("*").alias("n_rows"), F.count("det").alias("detections"), F.count("scan_ts").alias("dates")))
    return reduce(DataFrame.unionByName, rows)


def file_tree_audit(spark: SparkSession, sf: str) -> DataFrame:
    """``documents`` as files in folders by class and hash, read back, hashed and compared with the wanted ones."""
    folder = scratch_dir(spark)
    adapters.write_tree(spark, sf, f"{folder}/tree")
    found = files.hashed_files(spark, f"{folder}/tree", "class=*/hash=*/*.txt", r"class=([^/]+)/hash=([^/]+)/[^/]+$")
    return fetch.audit_files(adapters.wanted_tree(spark, sf), found)


def hash_export(spark: SparkSession, sf: str) -> DataFrame:
    """The exported hash lists, read back."""
    folder = scratch_dir(spark)
    written = sample_store.export_hashes(_sample(spark, sf), f"{folder}/hashes")
    return spark.read.text(written).select(
        F.regexp_extract("_metadata.file_path", r"/(\w+)\.txt/", 1).alias("class"), F.col("value").alias("sha256")
    )


def live_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Totals of a streaming run over the attempt log; what the batch roll-up gives."""
    folder = scratch_dir(spark)
    schema = adapters.table(spark, sf, "events").schema
    log = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)

    written = []

    def keep(batch: DataFrame, batch_id: int) -> None:
        written.append(f"{folder}/totals/batch={batch_id}")
        batch.write.mode("overwrite").parquet(written[-1])

    query = (
        live_attempts(adapters.attempts_of(log))
        .writeStream.outputMode("complete")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(keep)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(written[-1])


def live_totals_retries(spark: SparkSession, sf: str) -> DataFrame:
    """Live totals of planned rows, retries and repeated keys included; what the batch roll-up gives."""
    folder = scratch_dir(spark)
    schema = adapters.table(spark, sf, "events").schema
    log = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    plan, written = adapters.repeating_plan(spark, sf), []

    def keep(batch: DataFrame, batch_id: int) -> None:
        written.append(f"{folder}/totals/batch={batch_id}")
        live_rollup(batch, plan).write.mode("overwrite").parquet(written[-1])

    query = (
        live_targets(adapters.retries_of(log))
        .writeStream.outputMode("complete")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(keep)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(written[-1])


def columns_by_header(spark: SparkSession, sf: str) -> DataFrame:
    """Files of five kinds: fixed columns, another order, columns that nobody knows, an absent one, line breaks in quotes."""
    folder = scratch_dir(spark)
    rows = adapters.catalog_in_kinds(spark, sf)
    missing = [f for f in source.RAW_SCHEMA.fields if f.name not in rows.columns]
    rows = rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing})
    fields = list(source.CATALOG_FIELDS)
    layouts = [fields, fields[::-1], ["before", *fields, "after"], [f for f in fields if f != "apk_size"], fields]
    rows = rows.withColumns({"before": F.lit("x"), "after": F.col("pkg_name")})
    for kind, layout in enumerate(layouts):
        rows.where(F.col("kind") == kind).select(*layout).write.option("header", True).option("escape", '"').option("compression", "gzip").csv(f"{folder}/csv/{kind}")
    source.refresh_table(spark, f"{folder}/csv/*", f"{folder}/table")
    return source.read_table(spark, f"{folder}/table").select("sha256", "pkg_name", "det", "apk_size", "markets")


def refresh_in_compaction(spark: SparkSession, sf: str) -> DataFrame:
    """One of two sources is replaced while the table is being compacted: the table holds the new rows, compacted or not."""
    folder = scratch_dir(spark)
    table = f"{folder}/table"
    for name, where in (("a/one", "apk_size % 2 = 0"), ("a/two", "apk_size % 2 = 1"), ("b/two", "apk_size % 4 = 1")):
        _split_csv(spark, sf, f"{folder}/{name}", where)
    source.refresh_table(spark, f"{folder}/a/*", table)
    rewrite = source.rewrite_table(spark, table)
    source.refresh_table(spark, f"{folder}/{{a/one,b/two}}", table)
    source.publish_rewrite(spark, table, rewrite)
    compacted = source.read_table(spark, table).groupBy("gen").agg(F.count("*").alias("n_rows"), F.sum("apk_size").alias("bytes"))
    return compacted.select(
        F.when(F.col("gen") == rewrite.gen, "compacted").otherwise("refreshed").alias("step"), "n_rows", "bytes"
    )


def streamed_changes(spark: SparkSession, sf: str) -> DataFrame:
    """The change-aware stream: two folders of files, then one whose files are replaced by others of other rows."""
    folder = scratch_dir(spark)
    rows = []
    for step, odd in (("a", "apk_size % 2 = 1"), ("b", "apk_size % 4 = 1")):
        for name, where in (("one", "apk_size % 2 = 0"), ("two", odd)):
            if step == "a" or name == "two":
                _split_csv(spark, sf, f"{folder}/csv/{name}", where)
        stream_refresh(spark, f"{folder}/csv/*", f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
        rows.append(_kept(_held(spark, f"{folder}/table", step)))
    return reduce(DataFrame.unionByName, rows)


def file_tree_unreadable(spark: SparkSession, sf: str) -> DataFrame:
    """The tree of ``file_tree_audit``, with files that were listed and cannot be read any more."""
    folder = scratch_dir(spark)
    adapters.write_tree(spark, sf, f"{folder}/tree")
    listed = files.listed_files(spark, f"{folder}/tree", "class=*/hash=*/*.txt", r"class=([^/]+)/hash=([^/]+)/[^/]+$")
    found = files.with_digests(listed.unionByName(adapters.lost_tree(spark, sf, folder)))
    return fetch.audit_files(adapters.wanted_tree(spark, sf), found)


def paired_by_place(spark: SparkSession, sf: str) -> DataFrame:
    """Attempts and plan rows paired by place in the list, places that repeat and that only one side has included."""
    log = fetch.classify_attempts(adapters.ranked_retries(spark, sf))
    return fetch.pair_outcomes(log, adapters.ranked_plan(spark, sf))


def sample_one_per_key(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(collect.collect_sample(adapters.catalog_with_copies(spark, sf), SHORT, one_per_key=True))


def _replaced_table(spark: SparkSession, sf: str, report: Callable[[str], DataFrame]) -> DataFrame:
    """A report after a first refresh, and after a second one that replaced one of two sources."""
    folder = scratch_dir(spark)
    for name, where in (("a/one", "apk_size % 2 = 0"), ("a/two", "apk_size % 2 = 1"), ("b/two", "apk_size % 4 = 1")):
        _split_csv(spark, sf, f"{folder}/{name}", where)
    rows = []
    for step, sources in (("a", "a/*"), ("b", "{a/one,b/two}")):
        source.refresh_table(spark, f"{folder}/{sources}", f"{folder}/table")
        rows.append(_kept(report(f"{folder}/table")).withColumn("step", F.lit(step)))
    return rows[0].unionByName(rows[1])


def _kept(report: DataFrame) -> DataFrame:
    """A report as it is now: a few rows."""
    return report.sparkSession.createDataFrame(report.collect(), report.schema)


def survey_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """Overview from the summaries of generations; the window cuts through its first and its last day."""
    out = _replaced_table(spark, sf, lambda t: incremental.survey_overview(spark, t, CUT, on_bad_date="drop"))
    return out.withColumns({"avg_bytes": F.round("avg_bytes", 4), "est_total_mb": F.round("est_total_mb", 4)})


def dist_incremental(spark: SparkSession, sf: str) -> DataFrame:
    return _replaced_table(spark, sf, lambda t: incremental.survey_distribution(spark, t, SPEC, "month", on_bad_date="drop"))


def sample_from_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Samples merged from the summaries of generations, of which the second refresh adds one."""

    def draw(table: str) -> DataFrame:
        sample = summaries.sample_from_summaries(spark, table, f"{table}-samples", SPEC, on_bad_date="drop")
        if sample is None:
            raise ValueError("the summaries cannot tell")
        return sample.select("class", "sample_rank", "sha256", "apk_size")

    return _replaced_table(spark, sf, draw)


def live_verdict_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Totals after a stream of eight batches that writes verdict changes only, and how many of these there were."""
    folder = scratch_dir(spark)
    events = adapters.table(spark, sf, "events")
    events.repartitionByRange(8, "event_id").write.parquet(f"{folder}/events")
    log = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/events")
    plan, batches = adapters.repeating_plan(spark, sf), []
    keep = keep_totals(plan, folder)

    def write(changes: DataFrame, batch_id: int) -> None:
        batches.append(batch_id)
        keep(changes, batch_id)

    (
        verdict_changes(adapters.retries_of(log), plan)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    totals = totals_of(spark.read.parquet(f"{folder}/totals/batch={max(batches)}"))
    none = F.lit(0).cast("bigint")
    changed = spark.read.option("basePath", f"{folder}/changes").parquet(f"{folder}/changes").agg(
        F.lit("changes").alias("class"), F.count("*").alias("succeeded"), none.alias("failed"), none.alias("bytes")
    )
    return totals.unionByName(changed)


def queries() -> dict[str, Query]:
    return {
        "dist_year": _distribution("year"),
        "dist_quarter": _distribution("quarter"),
        "dist_month": _distribution("month"),
        "dist_all_markets": _distribution("year", ALL_MARKETS),
        "dist_threshold0": _distribution("year", THRESHOLD_0),
        "summary_survey": _summary(SPEC, "survey"),
        "summary_collect": _summary(SPEC, "collect"),
        "summary_threshold0": _summary(THRESHOLD_0, "survey"),
        "summary_all_markets": _summary(ALL_MARKETS, "survey"),
        "summary_nothing": _summary(LATER, "collect"),
        "shortage": _summary(SHORT, "collect"),
        "size_estimate": size_estimate,
        "survey_overview": survey_overview,
        "base_survey": _base("survey"),
        "base_collect": _base("collect"),
        "class_flags": class_flags,
        "malware_candidates": malware_candidates,
        "cleanware_candidates": cleanware_candidates,
        "both_classes": both_classes,
        "scalar_columns": scalar_columns,
        "lenient_predicates": lenient_predicates,
        "parse_edge": parse_edge,
        "sample_malware": sample_malware,
        "sample_cleanware": sample_cleanware,
        "sample_union": sample_union,
        "sample_survey": sample_survey,
        "sample_take_all": sample_take_all,
        "sample_overlap": sample_overlap,
        "sample_trim": sample_trim,
        "sample_of_copies": sample_of_copies,
        "sample_size_pretty": sample_size_pretty,
        "work_list": work_list,
        "fetch_plan": _fetch_plan(True),
        "fetch_plan_unverified": _fetch_plan(False),
        "planned_bytes": planned_bytes,
        "file_audit": file_audit,
        "audit_summary": audit_summary,
        "attempt_outcomes": attempt_outcomes,
        "outcome_counts": outcome_counts,
        "class_rollup": class_rollup,
        "paired_outcomes": paired_outcomes,
        "attempt_rollup": attempt_rollup,
        "run_verdict": run_verdict,
        "typed_table": typed_table,
        "refresh_twice": refresh_twice,
        "streamed_table": streamed_table,
        "stored_sample": stored_sample,
        "hash_export": hash_export,
        "live_totals": live_totals,
        "rollup_repeated_keys": rollup_repeated_keys,
        "live_totals_retries": live_totals_retries,
        "outcome_labels": outcome_labels,
        "survey_bad_date": survey_bad_date,
        "stored_sample_by_key": stored_sample_by_key,
        "store_damaged": store_damaged,
        "refresh_replaced": refresh_replaced,
        "refresh_failed": refresh_failed,
        "stream_new_checkpoint": stream_new_checkpoint,
        "open_by_suffix": open_by_suffix,
        "file_tree_audit": file_tree_audit,
        "columns_by_header": columns_by_header,
        "refresh_in_compaction": refresh_in_compaction,
        "streamed_changes": streamed_changes,
        "file_tree_unreadable": file_tree_unreadable,
        "paired_by_place": paired_by_place,
        "sample_one_per_key": sample_one_per_key,
        "survey_incremental": survey_incremental,
        "dist_incremental": dist_incremental,
        "sample_from_summaries": sample_from_summaries,
        "live_verdict_changes": live_verdict_changes,
    }
