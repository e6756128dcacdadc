"""Multi-party perspective rotation of dialogues, by DataFrame functions only.

For every participant of a dialogue one training example is rendered: that speaker's turns become ``assistant``, the
other speakers' turns become ``user name=<speaker>``, system turns stay ``system``. The mask lists the half-open
character ranges whose tokens bear loss: what the assistant says and the end mark after it.

A dialogue of up to ``RANGE`` turns is one example for each participant. A longer one is dealt into consecutive ranges of
its order, of ``RANGE`` turns each, and every range is rendered for every participant of the whole dialogue; ``block`` is
the range's number, so the examples of a speaker, by block, are the whole dialogue in order. Ranges come from running
counts over stretches of the order, each of them a task's, with equal turns counted first. So no group is unbounded,
whatever the dialogue's length.

Defined results: turns are ordered by number (null first), then role, then text; a null text is empty, a null or empty
role is ``unknown``; a dialogue of system turns alone has no participant and gives nothing; rows without a dialogue id
form one dialogue whose id is null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievecraft.llm.text import table
from sievecraft.scratch import staged

#: Marks of the rendered form.
START, END = "<|im_start|>", "<|im_end|>\n"
#: Turns in a range of a long dialogue.
RANGE = 512


def head_of(role: Column, speaker: Column) -> Column:
    return (
        F.when(role == "system", F.lit(f"{START}system\n"))
        .when(role == speaker, F.lit(f"{START}assistant\n"))
        .otherwise(F.concat(F.lit(f"{START}user name="), role, F.lit("\n")))
    )


def with_ranges(turns: DataFrame, range_turns: int) -> DataFrame:
    """``turns`` (conv_id, turn, role, text, copies) with ``block``, the range they lie in, and their copies in it."""
    order = ("turn", "role", "text")
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turns = turns.repartitionByRange(parts, "conv_id", *order).withColumn("_part", F.spark_partition_id())
    turns = staged(turns, "long-dialogues")
    sizes = turns.groupBy(F.col("conv_id").alias("c"), F.col("_part").alias("p")).agg(F.sum("copies").alias("_size"))
    before = Window.partitionBy("c").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("c", "p", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("conv_id", "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.withColumn("_before", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    placed = placed.join(starts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("_part") == F.col("p")))
    first = F.col("_start") + F.col("_before")
    placed = placed.withColumns({"_first": first, "_stop": first + F.col("copies")})
    number = lambda at: F.floor(at / range_turns).cast("long")
    placed = placed.withColumn("block", F.explode(F.sequence(number(F.col("_first")), number(F.col("_stop") - 1))))
    copies = F.least("_stop", (F.col("block") + 1) * range_turns) - F.greatest("_first", F.col("block") * range_turns)
    return placed.select("conv_id", "block", *order, copies.alias("copies"))


def rotate(conversations: DataFrame, range_turns: int = RANGE) -> DataFrame:
    """conv_id, block, speaker, n_turns, text, mask (list of start, stop), n_loss_chars."""
    role = F.coalesce(F.when(F.trim("role") != "", F.trim("role")), F.lit("unknown"))
    turns = conversations.select("conv_id", "turn", role.alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    long = turns.groupBy(F.col("conv_id").alias("c")).agg(F.count("*").alias("n")).where(F.col("n") > range_turns)
    long = staged(long.select("c"), "long-ids")
    turns = turns.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    is_long = F.col("conv_id").eqNullSafe(F.col("c"))
    ranges = with_ranges(turns.join(long, is_long, "left_semi"), range_turns)

    def gathered(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("copies", F.col("copies").cast("int"))
        return rows.groupBy("conv_id", "block").agg(
            F.sort_array(F.collect_list(F.struct("turn", "role", "text", "copies"))).alias("turns")
        )

    whole = gathered(turns.join(long, is_long, "left_anti").withColumn("block", F.lit(0).cast("long")))
    speakers = F.array_sort(F.array_distinct(F.transform("turns", lambda t: t["role"])))
    whole = whole.withColumn("speaker", F.explode(F.filter(speakers, lambda r: r != "system")))
    # a long dialogue's participants are those of all its ranges
    spoke = ranges.where(F.col("role") != "system").select(F.col("conv_id").alias("c"), F.col("role").alias("speaker"))
    grouped = whole.unionByName(gathered(ranges).join(spoke.distinct(), is_long).drop("c"))
    laid = F.flatten(F.transform("turns", lambda t: F.array_repeat(t, t["copies"])))
    said = F.transform(
        laid,
        lambda t: F.struct(
            head_of(t["role"], F.col("speaker")).alias("head"),
            F.concat(t["text"], F.lit(END)).alias("body"),
            ((t["role"] == F.col("speaker")) & (t["role"] != "system")).alias("loss"),
        ),
    )
    example = grouped.select("conv_id", "block", "speaker", said.alias("said"))
    nothing = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)").alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        start = state["at"] + F.char_length(turn["head"])
        stop = start + F.char_length(turn["body"])
        span = F.array(F.struct(start.alias("start"), stop.alias("stop")))
        return F.struct(
            stop.cast("long").alias("at"),
            F.when(turn["loss"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    mask = F.aggregate("said", nothing, step)["spans"]
    return example.select(
        "conv_id", "block", "speaker", F.size("said").cast("long").alias("n_turns"),
        F.array_join(F.transform("said", lambda t: F.concat(t["head"], t["body"])), "").alias("text"), mask.alias("mask"),
    )


def op7_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dialogue from every participant's side; the mask as ``start-stop`` ranges."""
    out = rotate(table(spark, sf_dir, "conversations"))
    ranges = F.array_join(F.transform("mask", lambda s: F.concat_ws("-", s["start"], s["stop"])), ",")
    loss = F.aggregate("mask", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return out.select(
        "conv_id", "block", "speaker", "n_turns", "text", ranges.alias("loss_ranges"), loss.alias("n_loss_chars")
    )


#: The same in DuckDB: ranges by row number over the whole dialogue.
OP7_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, CASE WHEN trim(role) <> '' THEN trim(role) ELSE 'unknown' END AS role, coalesce(text, '') AS text
  FROM conversations),
n AS (
  SELECT *, (k - 1) // {RANGE} AS block
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM t)),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
p AS (
  SELECT n.conv_id, n.block, s.speaker, n.k, n.role = s.speaker AS loss,
         CASE WHEN n.role = 'system' THEN '{START}system' || chr(10)
              WHEN n.role = s.speaker THEN '{START}assistant' || chr(10)
              ELSE '{START}user name=' || n.role || chr(10) END AS head,
         n.text || '<|im_end|>' || chr(10) AS body
  FROM n JOIN s ON n.conv_id IS NOT DISTINCT FROM s.conv_id),
q AS (
  SELECT *, CAST(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, block, speaker ORDER BY k) AS BIGINT) AS stop
  FROM p)
SELECT conv_id, CAST(block AS BIGINT) AS block, speaker, count(*) AS n_turns, string_agg(head || body, '' ORDER BY k) AS text,
       coalesce(string_agg(CASE WHEN loss THEN (stop - length(body)) || '-' || stop END, ',' ORDER BY k), '') AS loss_ranges,
       CAST(sum(CASE WHEN loss THEN length(body) ELSE 0 END) AS BIGINT) AS n_loss_chars
FROM q GROUP BY conv_id, block, speaker
"""
