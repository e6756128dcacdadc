from pyspark.sql import functions as F

from sievecraft.operators import fetch
from sievecraft.sources import catalog as source
from sievecraft.streaming.refresh import apply_changes, log_changes, stream_refresh
from sievecraft.streaming import rollup
from sievecraft.streaming.rollup import live_attempts
from tests.fixtures import csv_text, row


def test_refresh_stream(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    csv, table, checkpoint = (f"{tmp_path}/{n}" for n in ("csv", "table", "checkpoint"))

    def run(**options):
        stream_refresh(spark, csv, table, checkpoint, **options).awaitTermination()
        return source.read_table(spark, table).count()

    def put(name, rows):
        (tmp_path / "csv" / name).write_text(csv_text(rows))

    put("a.csv", [row(i) for i in range(20)])
    assert run() == 20
    assert run() == 20
    put("b.csv", [row(100 + i, date="bad" if i else None) for i in range(5)])
    put("c.csv", [row(200)])
    assert run(max_files_per_batch=1) == 26
    live = source.live_sources(spark, table)
    assert live.count() == 3 and live.select("gen").distinct().count() == 3
    # what the stream took in, the batch refresh knows
    assert source.is_current(spark, csv, table)
    # a file that is rewritten in place, one that goes, and a stream that begins again with its checkpoint
    put("a.csv", [row(300)])
    (tmp_path / "csv" / "b.csv").unlink()
    assert run() == 2
    assert source.is_current(spark, csv, table)
    assert run() == 2
    batch = f"{tmp_path}/batch"
    source.refresh_table(spark, csv, batch)
    assert sorted(r.sha256 for r in source.read_table(spark, table).collect()) == sorted(
        r.sha256 for r in source.read_table(spark, batch).collect()
    )


def test_stream_retires_only_what_it_brought(spark, tmp_path):
    for name, key in (("one", 1), ("two", 2)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.csv").write_text(csv_text([row(key)]))
    table = f"{tmp_path}/table"
    for name in ("one", "two"):
        stream_refresh(spark, f"{tmp_path}/{name}", table, f"{tmp_path}/check-{name}").awaitTermination()
    (tmp_path / "one" / "a.csv").unlink()
    (tmp_path / "one" / "b.csv").write_text(csv_text([row(3)]))
    stream_refresh(spark, f"{tmp_path}/one", table, f"{tmp_path}/check-one").awaitTermination()
    assert sorted(int(r.sha256, 16) for r in source.read_table(spark, table).collect()) == [2, 3]


def test_changes_that_are_outdated_are_left_alone(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    file = tmp_path / "csv" / "a.csv"
    file.write_text(csv_text([row(1)]))
    log = f"{tmp_path}/log"
    assert log_changes(spark, f"{tmp_path}/csv", log) == 1
    first = spark.read.parquet(log)
    file.write_text(csv_text([row(1), row(2)]))
    apply_changes(spark, first, f"{tmp_path}/csv", f"{tmp_path}/table", "g1", "FAILFAST")
    assert source.read_table(spark, f"{tmp_path}/table").isEmpty()
    assert log_changes(spark, f"{tmp_path}/csv", log) == 1 and log_changes(spark, f"{tmp_path}/csv", log) == 0
    apply_changes(spark, spark.read.parquet(log), f"{tmp_path}/csv", f"{tmp_path}/table", "g2", "FAILFAST")
    assert source.read_table(spark, f"{tmp_path}/table").count() == 2


def test_live_rollup_equals_batch(spark, tmp_path):
    log = spark.range(300).select(
        F.when(F.col("id") % 2 == 0, "malware").otherwise("cleanware").alias("class"),
        F.sha2(F.col("id").cast("string"), 256).alias("sha256"),
        F.col("id").alias("apk_size"),
        (F.col("id") % 5).alias("bytes_downloaded"),
        F.when(F.col("id") % 3 == 0, F.col("id") % 4).alias("content_length"),
        F.sha2(F.col("id").cast("string"), 256).alias("computed_sha256"),
    )
    log.repartition(6).write.parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/log")
    query = (
        live_attempts(stream).writeStream.outputMode("complete").format("memory").queryName("live_totals_test")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) > 1
    want = fetch.class_rollup(fetch.classify_attempts(log)).collect()
    assert sorted(spark.table("live_totals_test").collect()) == sorted(want)


def test_verdicts_change_once(spark, tmp_path):
    """Totals after every batch equal the batch roll-up of what was logged so far, and only new successes are written."""
    plan_rows = [("malware", f"{i % 40:064x}".upper(), 10 + i) for i in range(60)] + [("cleanware", None, 7), ("cleanware", f"{1:064x}", 5)]
    plan = spark.createDataFrame(plan_rows, "class string, sha256 string, apk_size long")
    schema = "class string, sha256 string, bytes_downloaded long, content_length long, computed_sha256 string, error string"

    def attempt(i, ok, cls="malware"):
        key = f"{i:064x}"
        return (cls, key, 5, 5, key if ok else "bad", None)

    batches = [
        [attempt(i, i % 4 == 0) for i in range(20)] + [attempt(99, True)],
        [attempt(i, True) for i in range(0, 12)] + [attempt(0, False), attempt(1, True), attempt(1, True, "cleanware")],
        [attempt(i, False) for i in range(40)],
        [attempt(5, True), ("malware", None, 5, 5, "x", None)],
    ]
    folder, log = f"{tmp_path}/out", f"{tmp_path}/log"
    done = set()
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(log)
        stream = spark.readStream.schema(schema).parquet(log)
        (
            rollup.verdict_changes(stream, plan).writeStream.foreachBatch(rollup.keep_totals(plan, folder))
            .option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
        )
        batch = max(int(p.name.split("=")[1]) for p in (tmp_path / "out" / "totals").iterdir())
        got = rollup.totals_of(spark.read.parquet(f"{folder}/totals/batch={batch}"))
        want = fetch.attempt_rollup(spark.read.schema(schema).parquet(log), plan)
        columns = ("class", "succeeded", "failed", "bytes")
        assert sorted(got.select(*columns).collect()) == sorted(want.select(*columns).collect())
        new = {(c, k) for c, k, _, _, made, _ in rows if k and made == k and (c, k) in {(p[0], (p[1] or "").lower()) for p in plan_rows}} - done
        changes = [(r["class"], r.sha256) for b in range(batch + 1) for r in spark.read.parquet(f"{folder}/changes/batch={b}").collect()]
        assert len(changes) == len(set(changes)) and set(changes) == done | new
        done |= new
    # a batch that runs again leaves the same totals
    first = sorted(spark.read.parquet(f"{folder}/totals/batch=0").collect())
    again = spark.createDataFrame(spark.read.parquet(f"{folder}/changes/batch=0").collect())
    rollup.keep_totals(plan, folder)(again, 0)
    assert sorted(spark.read.parquet(f"{folder}/totals/batch=0").collect()) == first
