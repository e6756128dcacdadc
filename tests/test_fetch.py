import hashlib
from collections import Counter

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from sievecraft.operators import fetch
from sievecraft.sources import files

SAMPLE = "class string, sample_rank bigint, sha256 string, apk_size bigint"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture
def root(tmp_path):
    for cls, name, content in [
        ("malware", sha("a"), "a"),
        ("malware", sha("b"), "damaged"),
        ("cleanware", sha("c"), "c"),
        ("cleanware", sha("stray"), "stray"),
    ]:
        (tmp_path / cls).mkdir(exist_ok=True)
        (tmp_path / cls / f"{name}.apk").write_text(content)
    (tmp_path / "malware" / "notes.txt").write_text("not a file of the run")
    return str(tmp_path)


@pytest.fixture
def sample(spark):
    rows = [
        ("malware", 1, sha("a").upper(), 10),
        ("malware", 2, sha("b").upper(), 20),
        ("malware", 3, sha("d").upper(), None),
        ("cleanware", 1, sha("c").upper(), 5),
        ("cleanware", 2, sha("a").upper(), 10),
        ("cleanware", 3, None, 1),
    ]
    return spark.createDataFrame(rows, SAMPLE)


def test_inventory(spark, root):
    df = files.inventory(spark, root)
    assert {(r["class"], r.sha256, r.length) for r in df.collect()} == {
        ("malware", sha("a"), 1),
        ("malware", sha("b"), 7),
        ("cleanware", sha("c"), 1),
        ("cleanware", sha("stray"), 5),
    }
    assert "content" not in df._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_content_hash(spark, root):
    got = {r.sha256: r.content_sha256 for r in files.hashed_files(spark, root).collect()}
    assert got[sha("a")] == sha("a") and got[sha("b")] == sha("damaged")


def planned(df):
    return {(r["class"], r.sample_rank): r.path for r in df.collect()}


def test_plan(spark, root, sample):
    everything = files.hashed_files(spark, root)
    want = {
        ("malware", 3): f"malware/{sha('d')}.apk",
        ("cleanware", 2): f"cleanware/{sha('a')}.apk",  # there, but under the other class
        ("cleanware", 3): None,
    }
    assert planned(fetch.fetch_plan(sample, files.inventory(spark, root), verify=False)) == want
    want[("malware", 2)] = f"malware/{sha('b')}.apk"  # there, but not what it should be
    plan = fetch.fetch_plan(sample, everything)
    assert planned(plan) == want
    totals = {r["class"]: (r.files, r.bytes) for r in fetch.planned_bytes(plan).collect()}
    assert totals == {"malware": (2, 20), "cleanware": (2, 11), "total": (4, 31)}


def test_plan_without_files(spark, sample):
    none = spark.createDataFrame([], "class string, sha256 string, content_sha256 string")
    assert fetch.fetch_plan(sample, none).count() == 6


def test_audit(spark, root, sample):
    audit = fetch.audit_files(sample, files.hashed_files(spark, root))
    got = {(r["class"], r.sha256): r.status for r in audit.collect()}
    assert got == {
        ("malware", sha("a")): "VERIFIED",
        ("malware", sha("b")): "HASH_MISMATCH",
        ("malware", sha("d")): "MISSING",
        ("cleanware", sha("c")): "VERIFIED",
        ("cleanware", sha("a")): "MISSING",
        ("cleanware", ""): "MISSING",
        ("cleanware", sha("stray")): "UNEXPECTED",
    }
    counts = {(r["class"], r.status): r.targets for r in fetch.audit_summary(audit).collect()}
    assert counts[("cleanware", "MISSING")] == 2


def test_audit_of_a_crowded_target(spark):
    wanted = spark.range(1000).select(F.lit("malware").alias("class"), F.lit(sha("a")).alias("sha256"))
    one = spark.createDataFrame([("malware", sha("a"), sha("a"))], "class string, sha256 string, content_sha256 string")
    assert [tuple(r) for r in fetch.audit_files(wanted, one).collect()] == [
        ("malware", sha("a"), 1000, 1, "VERIFIED")
    ]


LOG = (
    "class string, sha256 string, bytes_downloaded bigint, content_length bigint, computed_sha256 string, "
    "error string, existing boolean, apk_size bigint"
)


@pytest.mark.parametrize(
    "attempt, outcome",
    [
        (("AB", 10, 10, "ab", None, False), "VERIFIED"),
        (("AB", 10, None, "AB", None, None), "VERIFIED"),
        (("AB", 10, 0, "ab", None, False), "VERIFIED"),
        (("AB", 10, 11, "ab", None, False), "INCOMPLETE"),
        (("AB", 10, 9, "ab", None, False), "INCOMPLETE"),
        (("AB", 0, 10, None, None, False), "NO_BYTES"),
        (("AB", None, None, None, None, False), "NO_BYTES"),
        (("AB", 10, 10, "cd", None, False), "HASH_MISMATCH"),
        (("AB", 10, 10, None, None, False), "HASH_MISMATCH"),
        (("AB", 10, 10, "", None, False), "HASH_MISMATCH"),
        ((None, 10, 10, "ab", None, False), "NO_SHA256"),
        (("", 10, 10, "", None, False), "NO_SHA256"),
        (("AB", None, None, None, "cancelled", True), "CANCELLED"),
        (("AB", None, None, None, None, True), "EXISTS"),
        (("AB", None, None, "ab", None, True), "EXISTS_VERIFIED"),
        (("AB", None, None, "cd", None, True), "HASH_MISMATCH"),
        (("AB", 5, 10, None, "interrupted", False), "INTERRUPTED"),
        (("AB", 5, 10, None, "Timeout", False), "TIMEOUT"),
        (("AB", 5, 10, None, "request", False), "REQUEST_ERROR"),
        (("AB", 5, 10, None, "file", False), "FILE_ERROR"),
        (("AB", 10, 10, "ab", "boom", False), "UNEXPECTED_ERROR"),
    ],
)
def test_outcomes(spark, attempt, outcome):
    df = spark.createDataFrame([("malware", *attempt, 1)], LOG)
    assert fetch.classify_attempts(df).head().outcome == outcome
    assert outcome in fetch.SUCCESSES + fetch.FAILURES
    assert (outcome in fetch.SUCCESSES) == fetch.classify_attempts(df).select(fetch.is_success(F.col("outcome"))).head()[0]


def log(spark, rows):
    return spark.createDataFrame(rows, "class string, sample_rank bigint, sha256 string, bytes_downloaded bigint, "
                                 "content_length bigint, computed_sha256 string")  # fmt: skip


def test_rollup(spark, sample):
    attempts = log(
        spark,
        [
            ("malware", 1, sha("a"), 0, None, None),
            ("malware", 1, sha("a"), 10, 10, sha("a")),  # a second try
            ("malware", 2, sha("b"), 10, 10, "bad"),
            ("cleanware", 2, sha("a"), 10, 10, sha("a")),
            ("cleanware", 99, sha("z"), 10, 10, sha("z")),  # nobody asked for it
        ],
    )
    rollup = fetch.attempt_rollup(attempts, sample)
    got = {r["class"]: (r.succeeded, r.failed, r.bytes) for r in rollup.collect()}
    assert got == {"malware": (1, 2, 10), "cleanware": (1, 2, 10), "total": (2, 4, 20)}
    tried = fetch.classify_attempts(attempts)
    assert tuple(fetch.run_verdict(rollup, tried, sample).head()) == (2, 4, "SUCCESS", False)
    stopped = tried.withColumn("outcome", F.lit("INTERRUPTED"))
    assert fetch.run_verdict(rollup, stopped, sample).head().verdict == "STOPPED"
    assert fetch.run_verdict(rollup, tried, sample.limit(1)).head().verdict == "ERROR"
    by_target = fetch.attempt_rollup(attempts.drop("sample_rank"), sample)
    assert {r["class"]: r.succeeded for r in by_target.collect()} == {"malware": 1, "cleanware": 1, "total": 2}


def test_complete_run(spark, sample):
    rows = [(r["class"], r.sample_rank, r.sha256, 1, 1, r.sha256) for r in sample.where("sha256 is not null").collect()]
    plan = sample.where("sha256 is not null")
    rollup = fetch.attempt_rollup(log(spark, rows), plan)
    verdict = fetch.run_verdict(rollup, fetch.classify_attempts(log(spark, rows)), plan)
    assert tuple(verdict.head()) == (5, 0, "SUCCESS", True)


def test_rollup_counts_rows_that_repeat_or_lack_a_key(spark):
    rows = [("malware", sha("a"), 10), ("malware", sha("a").upper(), 10), ("malware", None, 5), ("malware", None, 5)]
    plan = spark.createDataFrame(rows, "class string, sha256 string, apk_size bigint")
    attempts = log(spark, [("malware", 1, sha("a"), 10, 10, sha("a"))]).drop("sample_rank")
    got = {r["class"]: (r.succeeded, r.failed, r.bytes) for r in fetch.attempt_rollup(attempts, plan).collect()}
    assert got["total"] == (2, 2, 20)
    assert {r["class"]: (r.files, r.bytes) for r in fetch.planned_bytes(plan).collect()}["total"] == (4, 30)


def test_pairs(spark, sample):
    attempts = fetch.classify_attempts(log(spark, [("malware", 1, sha("a"), 10, 10, sha("a"))] * 3))
    pairs = fetch.pair_outcomes(attempts, sample).collect()
    assert Counter((r.outcome, r.attempts) for r in pairs) == {("VERIFIED", 3): 1, (None, 0): 5}


def test_work_list_keeps_overlap(sample):
    row = sample.limit(1)
    assert fetch.work_list(row, row).count() == 2


def test_files_of_any_size_and_files_that_cannot_be_read(spark, root, tmp_path):
    large = tmp_path / "malware" / f"{sha('large')}.apk"
    with open(large, "wb") as f:
        f.truncate((1 << 31) + 5)  # more than one row of Spark's can hold; without blocks on disk
    gone = tmp_path / "malware" / f"{sha('gone')}.apk"
    odd = tmp_path / "malware" / f"a b%20#é[{sha('odd')}].apk"
    gone.write_text("gone")
    odd.write_text("odd")
    listed = files.listed_files(spark, root)
    kept = spark.createDataFrame(listed.collect(), listed.schema)
    gone.unlink()
    got = {r.sha256: (r.content_sha256, r.readable, r.length) for r in files.with_digests(kept).collect()}
    assert {r.sha256 for r in files.hashed_files(spark, root).collect()} == set(got) - {sha("gone")}
    zeros = hashlib.sha256()
    for _ in range(1 << 11):
        zeros.update(bytes(1 << 20))
    zeros.update(bytes(5))
    assert got[sha("large")] == (zeros.hexdigest(), True, (1 << 31) + 5)
    assert got[sha("gone")] == ("", False, 4)
    assert got[f"a b%20#é[{sha('odd')}]"] == (sha("odd"), True, 3)
    assert got[sha("a")][:2] == (sha("a"), True)


def test_audit_of_unreadable_files(spark):
    wanted = spark.createDataFrame([("m", k) for k in "abcd"], "class string, sha256 string")
    rows = [("m", "a", "", False), ("m", "b", "b", True), ("m", "b", "", False), ("m", "c", "x", True), ("m", "c", "", False), ("m", "e", "", False)]
    found = spark.createDataFrame(rows, "class string, sha256 string, content_sha256 string, readable boolean")
    got = {r.sha256: r.status for r in fetch.audit_files(wanted, found).collect()}
    assert got == {"a": "UNREADABLE", "b": "UNREADABLE", "c": "HASH_MISMATCH", "d": "MISSING", "e": "UNEXPECTED"}
    # an unreadable file is fetched again
    assert {r.sha256 for r in fetch.fetch_plan(wanted, found).collect()} == {"a", "c", "d"}


@pytest.mark.parametrize("sent", [0, 10**6])
def test_plan_sends_a_short_list_to_the_inventory(spark, root, sample, monkeypatch, sent):
    monkeypatch.setattr(fetch, "SENT_TARGETS", sent)
    plan = fetch.fetch_plan(sample, files.hashed_files(spark, root))
    assert set(planned(plan)) == {("malware", 2), ("malware", 3), ("cleanware", 2), ("cleanware", 3)}


def test_inventory_is_not_shuffled_for_a_short_list(spark, sample, tmp_path):
    spark.range(1000).selectExpr("'malware' AS class", "sha2(string(id), 256) AS sha256", "sha2(string(id), 256) AS content_sha256").write.parquet(f"{tmp_path}/inventory")
    targets = sample.select("class", F.lower("sha256").alias("_sha256"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = fetch.files_asked_for(spark.read.parquet(f"{tmp_path}/inventory"), targets)
        plan = asked._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_tasks_list_the_folders_of_a_tree(spark, tmp_path, monkeypatch):
    """One folder for each file: neither the driver's listing nor Spark's writer goes through them one by one."""
    tree = f"{tmp_path}/tree"
    rows = [(f"class={c}/hash={h}/part-0.txt", h.encode()) for c in ("a", "b") for h in ("AB", "cd", "__HIVE_DEFAULT_PARTITION__")]
    rows += [("class=a/hash=ab/_hidden.txt", b""), ("class=a/hash=ab/other.csv", b""), ("class=a/part-0.txt", b""), ("x/hash=ab/part-0.txt", b"")]
    rows += [("class=b/hash=ef/folder.txt/part-0.bin", b"four"), ("class=b/hash=ef/folder.txt/below/part-0.bin", b"")]
    files.write_files(spark.createDataFrame(rows, "path string, content binary"), tree)
    how = (spark, tree, "class=*/hash=*/*.txt", r"class=([^/]+)/hash=([^/]+)/")
    by_spark = files._files(*how).select("class", "sha256", "length", "path").collect()

    def refuse(*_):
        raise AssertionError("listed by the driver")

    monkeypatch.setattr(files, "_files", refuse)
    got = files.listed_files(*how)
    assert sorted(got.collect()) == sorted(by_spark) and got.count() == 7
    assert {r.content_sha256 for r in files.hashed_files(*how).collect()} >= {sha("AB"), sha("four")}


def test_a_tree_without_files_is_refused_as_before(spark, tmp_path):
    (tmp_path / "malware").mkdir()
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        files.listed_files(spark, str(tmp_path))
