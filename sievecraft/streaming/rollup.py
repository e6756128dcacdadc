"""Live totals of a run from its attempt log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievecraft.operators.aggregates import with_total_row
from sievecraft.operators.fetch import TARGET, class_rollup, classify_attempts, is_success, rollup_of


def live_attempts(log_stream: DataFrame) -> DataFrame:
    """Attempts that went well and badly, and completed bytes, per class over a streaming log; retries count each.

    The state is one row per class, so it needs no watermark; write it in ``complete`` or ``update`` mode.
    """
    return class_rollup(classify_attempts(log_stream))


def live_targets(log_stream: DataFrame) -> DataFrame:
    """How often each target has had each outcome so far, over a streaming log.

    The state is a row for each target and outcome of the run. In ``update`` mode a batch brings those that changed, in
    ``complete`` mode all of them; ``live_rollup`` turns the latter into the totals that the batch roll-up gives.
    """
    attempts = classify_attempts(log_stream).withColumn("sha256", F.lower("sha256"))
    return attempts.groupBy(*TARGET, "outcome").agg(F.count(F.lit(1)).alias("attempts"))


def live_rollup(targets: DataFrame, plan: DataFrame) -> DataFrame:
    """Planned rows that ended well or not, as ``attempt_rollup`` gives them, from one batch of ``live_targets``."""
    rows = plan.withColumn("sha256", F.lower("sha256")).groupBy(*TARGET).agg(
        F.count(F.lit(1)).alias("plan_rows"), F.coalesce(F.sum("apk_size"), F.lit(0)).alias("plan_bytes")
    )
    return rollup_of(rows.join(targets, TARGET, "left").withColumn("planned", F.lit(True)))


def planned_targets(plan: DataFrame) -> DataFrame:
    """Distinct targets of a plan with their rows and bytes; rows without a hash or a class have no target."""
    rows = plan.withColumn("sha256", F.lower("sha256")).where("sha256 is not null and class is not null")
    return rows.groupBy(*TARGET).agg(
        F.count(F.lit(1)).alias("plan_rows"), F.coalesce(F.sum("apk_size"), F.lit(0)).cast("bigint").alias("plan_bytes")
    )


def verdict_changes(log_stream: DataFrame, plan: DataFrame) -> DataFrame:
    """Targets of the plan at the moment they turn from failed to succeeded, over a streaming log; append mode.

    A target without a success has failed, and one success settles it, whatever comes before or after: so a verdict changes
    once. The state is the settled targets, of which a batch emits those that are new: what it writes is in proportion to
    them and not to the run.
    """
    done = classify_attempts(log_stream).where(is_success(F.col("outcome"))).select("class", F.lower("sha256").alias("sha256"))
    return done.join(planned_targets(plan), TARGET).dropDuplicates(TARGET)


def totals_at_start(plan: DataFrame) -> DataFrame:
    """What the batch roll-up gives before any attempt, without its total row: every planned row has failed."""
    return plan.groupBy("class").agg(
        F.lit(0).cast("bigint").alias("succeeded"), F.count(F.lit(1)).alias("failed"), F.lit(0).cast("bigint").alias("bytes")
    )


def totals_after(before: DataFrame, changes: DataFrame) -> DataFrame:
    """Class totals after some changes: one row a class on one side, partial sums on the other."""
    moved = changes.select(
        "class", F.col("plan_rows").alias("succeeded"), (-F.col("plan_rows")).alias("failed"), F.col("plan_bytes").alias("bytes")
    )
    sums = [F.sum(c).cast("bigint").alias(c) for c in ("succeeded", "failed", "bytes")]
    return before.unionByName(moved).groupBy("class").agg(*sums)


def keep_totals(plan: DataFrame, folder: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` over ``verdict_changes``: writes each batch's changes and the class totals after it.

    ``<folder>/changes/batch=<id>`` and ``<folder>/totals/batch=<id>``. A batch that runs again replaces its own output, as
    it starts from the totals of the batch before it.
    """

    def keep(changes: DataFrame, batch_id: int) -> None:
        spark = changes.sparkSession
        own = f"{folder}/changes/batch={batch_id}"
        changes.write.mode("overwrite").parquet(own)
        if batch_id:
            before = spark.read.parquet(f"{folder}/totals/batch={batch_id - 1}")
        else:
            before = totals_at_start(plan)
        after = totals_after(before, spark.read.schema(changes.schema).parquet(own))
        after.coalesce(1).write.mode("overwrite").parquet(f"{folder}/totals/batch={batch_id}")

    return keep


def totals_of(class_totals: DataFrame) -> DataFrame:
    """Class totals with the total row, as the batch roll-up gives them."""
    return with_total_row(class_totals, "succeeded", "failed", "bytes")
