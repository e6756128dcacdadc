"""The data side of fetching: what to fetch, whether files are what they should be, how attempts went.

Fetching itself is not done here. A plan goes out to a fetcher; its files and its attempt log come back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievecraft.functions import columns as C
from sievecraft.operators.aggregates import with_total_row
from sievecraft.scratch import staged

# Outcomes of one attempt.
SUCCESSES = ("VERIFIED", "EXISTS_VERIFIED", "EXISTS")
FAILURES = (
    "NO_SHA256", "CANCELLED", "INTERRUPTED", "TIMEOUT", "REQUEST_ERROR", "FILE_ERROR", "UNEXPECTED_ERROR",
    "NO_BYTES", "INCOMPLETE", "HASH_MISMATCH",
)

TARGET = ["class", "sha256"]


def work_list(*samples: DataFrame) -> DataFrame:
    """Samples of both classes in one list; a row drawn for both classes stays twice."""
    rows = samples[0]
    for other in samples[1:]:
        rows = rows.unionByName(other, allowMissingColumns=True)
    return rows


def present_files(inventory: DataFrame, verify: bool) -> DataFrame:
    """Distinct files that need no fetching: all there are, or with ``verify`` only those with the right content."""
    if verify:
        inventory = inventory.where(F.col("content_sha256") == F.lower("sha256"))
    return inventory.select("class", F.lower("sha256").alias("_sha256")).distinct()


#: Targets of a sample that every task may hold (some 100 bytes each).
SENT_TARGETS = 500_000


def files_asked_for(inventory: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows of the inventory whose target (class, _sha256) is among ``targets``, a much smaller list.

    Up to ``SENT_TARGETS`` of them, counted here, go to every task, and the inventory is filtered where it is read. A longer
    list leaves the inventory as it is: the join that follows then shuffles both sides.
    """
    targets = targets.select("class", "_sha256").distinct().limit(SENT_TARGETS + 1)
    targets = staged(targets, "targets")
    if targets.count() > SENT_TARGETS:
        return inventory
    own = inventory.withColumn("_sha256", F.lower("sha256"))
    return own.join(F.broadcast(targets), ["class", "_sha256"], "left_semi").drop("_sha256")


def fetch_plan(sample: DataFrame, inventory: DataFrame, verify: bool = True) -> DataFrame:
    """Sample rows still to be fetched, with target path and size.

    ``verify`` asks for ``content_sha256`` in the inventory and plans files with the wrong content again. A row
    without a hash stays in the plan, with no path, and takes no part in the join: it matches nothing, and all such rows
    would meet in one task. Rows that repeat a key make no hot task: the anti join splits their side when it is skewed,
    and the inventory side is distinct. The inventory is not shuffled for a sample of up to ``SENT_TARGETS`` targets.
    """
    keep = [c for c in ("class", "sample_rank", "sha256", "apk_size") if c in sample.columns]
    wanted = sample.select(
        *keep,
        C.target_path(F.col("class"), F.col("sha256")).alias("path"),
        F.lower("sha256").alias("_sha256"),
    )
    hashed = wanted.where("_sha256 is not null and class is not null")
    asked = files_asked_for(inventory, hashed)
    missing = hashed.join(present_files(asked, verify), ["class", "_sha256"], "left_anti")
    return missing.unionByName(wanted.where("_sha256 is null or class is null")).select(*keep, "path")


def planned_bytes(plan: DataFrame) -> DataFrame:
    """Rows and bytes of a plan, per class and overall; a missing size counts as nothing."""
    per_class = plan.groupBy("class").agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("apk_size"), F.lit(0)).cast("bigint").alias("bytes"),
    )
    return with_total_row(per_class, "files", "bytes")


def audit_files(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """Compare wanted hashes with files; one row per target, whichever side it comes from.

    ``wanted`` has ``class, sha256``; ``files`` has ``class, sha256`` (the claimed hash, from the name) and
    ``content_sha256``, and may have ``readable``. The result has the number of wanted rows and of files, and a status:
    ``VERIFIED``, ``HASH_MISMATCH`` (a file holds something else than its name says), ``UNREADABLE`` (a file cannot be read,
    and those that can are right), ``MISSING`` or ``UNEXPECTED``.

    A union under one aggregate and no join: both sides shrink before the shuffle, so a target that is listed a
    billion times travels as one row per task.
    """
    none = F.lit(0).cast("bigint")
    one = F.lit(1).cast("bigint")
    key = F.coalesce(F.lower("sha256"), F.lit("")).alias("sha256")
    matches = F.coalesce(F.col("content_sha256") == F.lower("sha256"), F.lit(False))
    readable = F.coalesce(_optional(files, "readable", "boolean"), F.lit(True))
    both = wanted.select("class", key, one.alias("w"), none.alias("f"), none.alias("m"), none.alias("u")).unionByName(
        files.select(
            "class", key, none.alias("w"), one.alias("f"), (matches & readable).cast("bigint").alias("m"),
            (~readable).cast("bigint").alias("u"),
        )
    )
    status = (
        F.when(F.col("wanted_rows") == 0, "UNEXPECTED")
        .when(F.col("files") == 0, "MISSING")
        .when(F.col("_matching") == F.col("files"), "VERIFIED")
        .when(F.col("_matching") + F.col("_unreadable") == F.col("files"), "UNREADABLE")
        .otherwise("HASH_MISMATCH")
    )
    return (
        both.groupBy(*TARGET)
        .agg(
            F.sum("w").alias("wanted_rows"), F.sum("f").alias("files"), F.sum("m").alias("_matching"),
            F.sum("u").alias("_unreadable"),
        )
        .select(*TARGET, "wanted_rows", "files", status.alias("status"))
    )


def audit_summary(audit: DataFrame) -> DataFrame:
    return audit.groupBy("class", "status").agg(F.count(F.lit(1)).alias("targets"))


def _optional(df: DataFrame, name: str, dtype: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def classify_attempts(log: DataFrame) -> DataFrame:
    """Add ``outcome`` to an attempt log.

    Needs ``class, sha256, bytes_downloaded, content_length, computed_sha256``. Optional: ``error`` (``cancelled``,
    ``interrupted``, ``timeout``, ``request``, ``file`` or any other text) and ``existing``: true where the file was
    there already and was not fetched, with ``computed_sha256`` filled in only if it was checked.

    A length of NULL or 0 means that none was announced: any bytes are then all of them.
    """
    expected = F.lower("sha256")
    computed = F.lower("computed_sha256")
    n_bytes = F.coalesce("bytes_downloaded", F.lit(0))
    length = F.coalesce("content_length", F.lit(0))
    existing = F.coalesce(_optional(log, "existing", "boolean"), F.lit(False))
    error = F.lower(_optional(log, "error", "string"))
    outcome = (
        F.when(F.coalesce(expected, F.lit("")) == "", "NO_SHA256")
        .when(error == "cancelled", "CANCELLED")
        .when(existing & computed.isNull(), "EXISTS")
        .when(existing & (computed == expected), "EXISTS_VERIFIED")
        .when(error == "interrupted", "INTERRUPTED")
        .when(error == "timeout", "TIMEOUT")
        .when(error == "request", "REQUEST_ERROR")
        .when(error == "file", "FILE_ERROR")
        .when(error.isNotNull(), "UNEXPECTED_ERROR")
        .when(existing, "HASH_MISMATCH")
        .when(n_bytes <= 0, "NO_BYTES")
        .when((length > 0) & (n_bytes != length), "INCOMPLETE")
        .when(computed == expected, "VERIFIED")
        .otherwise("HASH_MISMATCH")
    )
    return log.withColumn("outcome", outcome)


def is_success(outcome: Column) -> Column:
    return outcome.isin(*SUCCESSES)


def outcome_counts(attempts: DataFrame) -> DataFrame:
    """Attempts per class and outcome, with the bytes of those that succeeded (needs ``apk_size``)."""
    size = F.when(is_success(F.col("outcome")), F.col("apk_size"))
    return attempts.groupBy("class", "outcome").agg(
        F.count(F.lit(1)).alias("attempts"), F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("bytes")
    )


def class_rollup(attempts: DataFrame) -> DataFrame:
    """Succeeded and failed attempts and completed bytes per class; also a streaming aggregation."""
    ok = is_success(F.col("outcome"))
    return attempts.groupBy("class").agg(
        F.count_if(ok).alias("succeeded"),
        F.count_if(~ok).alias("failed"),
        F.coalesce(F.sum(F.when(ok, F.col("apk_size"))), F.lit(0)).cast("bigint").alias("bytes"),
    )


def pair_outcomes(attempts: DataFrame, plan: DataFrame) -> DataFrame:
    """Attempts per plan row and outcome, plan rows without any attempt included (outcome NULL).

    Rows pair by place in the list (``class, sample_rank``) where both sides have it, else by target; plan rows with one
    target are then one row with their number and their bytes (``plan_rows``, ``plan_bytes``). Attempts are counted per row and outcome first, so that many retries of one
    target meet the plan as one row. Attempts that no plan row asked for come out with ``planned`` false.
    """
    on = ["class", "sample_rank"] if {"sample_rank"} <= {*attempts.columns} & {*plan.columns} else TARGET
    if on == TARGET:
        attempts = attempts.withColumn("sha256", F.lower("sha256"))
        plan = plan.withColumn("sha256", F.lower("sha256"))
    counted = attempts.groupBy(*on, "outcome").agg(F.count(F.lit(1)).alias("attempts"))
    sizes = plan.groupBy(*on).agg(
        F.max("apk_size").alias("apk_size"),
        F.count(F.lit(1)).alias("plan_rows"),
        F.coalesce(F.sum("apk_size"), F.lit(0)).alias("plan_bytes"),
        F.lit(True).alias("planned"),
    )
    return counted.join(sizes, on, "full_outer").withColumns(
        {
            "attempts": F.coalesce("attempts", F.lit(0)).cast("bigint"),
            "planned": F.coalesce("planned", F.lit(False)),
        }
    )


def attempt_rollup(log: DataFrame, plan: DataFrame) -> DataFrame:
    """Planned rows that ended well or not, per class and overall, with the catalogue bytes of the former.

    A row is a success if any of its attempts was; a row without an attempt has failed (it was cancelled or never
    started). Rows that repeat a target, or have none, count each.
    """
    return rollup_of(pair_outcomes(classify_attempts(log), plan))


def rollup_of(pairs: DataFrame) -> DataFrame:
    pairs = pairs.where("planned")
    on = [c for c in ("sample_rank", "sha256") if c in pairs.columns]
    ok = F.coalesce(is_success(F.col("outcome")), F.lit(False))
    rows = pairs.groupBy("class", *on).agg(
        F.bool_or(ok).alias("ok"), F.max("plan_rows").alias("plan_rows"), F.max("plan_bytes").alias("plan_bytes")
    )
    per_class = rows.groupBy("class").agg(
        F.sum(F.when(F.col("ok"), F.col("plan_rows")).otherwise(0)).cast("bigint").alias("succeeded"),
        F.sum(F.when(F.col("ok"), 0).otherwise(F.col("plan_rows"))).cast("bigint").alias("failed"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("plan_bytes"))), F.lit(0)).cast("bigint").alias("bytes"),
    )
    return with_total_row(per_class, "succeeded", "failed", "bytes")


def run_verdict(rollup: DataFrame, attempts: DataFrame, plan: DataFrame) -> DataFrame:
    """Overall verdict of a run: from its roll-up with a ``total`` row, its classified attempts and its plan.

    ``STOPPED`` if any attempt was cancelled or interrupted, ``ERROR`` if the roll-up does not add up to the plan, else
    ``SUCCESS``, failures or not; ``complete`` tells whether there were none.
    """
    stopped = F.col("outcome").isin("CANCELLED", "INTERRUPTED")
    none = F.lit(0).cast("bigint")
    facts = (
        rollup.where(F.col("class") == "total")
        .select("succeeded", "failed", none.alias("stopped"), none.alias("planned_rows"))
        .unionByName(attempts.select(none.alias("succeeded"), none.alias("failed"), stopped.cast("bigint").alias("stopped"), none.alias("planned_rows")))
        .unionByName(plan.select(none.alias("succeeded"), none.alias("failed"), none.alias("stopped"), F.lit(1).cast("bigint").alias("planned_rows")))
    )
    facts = facts.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in facts.columns])
    verdict = (
        F.when(F.col("stopped") > 0, "STOPPED")
        .when(F.col("succeeded") + F.col("failed") != F.col("planned_rows"), "ERROR")
        .otherwise("SUCCESS")
    )
    return facts.select("succeeded", "failed", verdict.alias("verdict"), (F.col("failed") == 0).alias("complete"))
