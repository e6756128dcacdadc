"""Samples of a typed table from summaries of its generations: a redraw after a refresh reads what is new only.

A generation never changes, so what it can ever contribute to a sample is written once, for a spec and a mode. A sample is
the rows of lowest score, and a row's score depends on its key and on its number among the rows of that key, which other
generations take part in. So a summary goes by the least score that a key can give with any number below ``COPIES``:

* it has every candidate row of the keys whose least score begins with at most its bound (four hex digits), which is
  chosen so that some ``2 * COPIES`` times the asked-for rows are in it;
* it says how many rows of one key there are in the generation at most.

A draw takes the rows of live sources from all summaries, up to the smallest of their bounds: these are all rows of all keys
that could score below it, and numbering and ranking them gives the table's own scores. The sample is right if its last
score is below the bound, and if no key can have more than ``COPIES`` rows, by the sum of the generations' maxima. Where
either fails the sample is drawn from the table. Layout::

    <store>/<family>/gen=<generation>/rows/*.parquet
    <store>/<family>/gen=<generation>/facts/*.parquet       written last
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievecraft.operators import copies, sampling
from sievecraft.plans import collect
from sievecraft.sources import catalog, manifest
from sievecraft.sources.schema import TABLE_SCHEMA
from sievecraft.spec import CLASSES, CollectionSpec

#: Rows that one key may have in all generations together.
COPIES = 8
#: Hex digits of a bound; the bound that nothing exceeds.
DIGITS = 4
ALL = "f" * DIGITS

FACTS = "class string, bound string, most long, asked long"


def family(spec: CollectionSpec, mode: str, on_bad_date: str | None) -> str:
    """Names the summaries of one order of candidates, whatever the table holds."""
    return spec.fingerprint("any generation", mode, on_bad_date)


def least_score(seed: int, key: str) -> Column:
    """Leading digits of the least score that a key can give."""
    text = F.concat(F.lit(f"{seed}:"), copies.key_text(key))
    scores = [F.sha2(text if n == 0 else F.concat(text, F.lit(f":{n}")), 256) for n in range(COPIES)]
    return F.substring(F.least(*scores), 1, DIGITS)


def _bounds(scored: DataFrame, asked: dict[str, int]) -> dict[str, str]:
    """For each class the digits up to which enough rows lie. At most 2 x 65,536 counts."""
    counts = scored.groupBy("class", "_least").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("class").orderBy("_least"))
    limits = F.create_map(*[F.lit(x) for cls, n in asked.items() for x in (cls, 2 * COPIES * n)])
    enough = counts.withColumn("_upto", upto).where(F.col("_upto") >= limits[F.col("class")])
    found = {r["class"]: r.bound for r in enough.groupBy("class").agg(F.min("_least").alias("bound")).collect()}
    return {cls: found.get(cls, ALL) for cls in asked}


def summarise(
    spark: SparkSession, table_dir: str, store: str, spec: CollectionSpec, mode: str = "collect", on_bad_date: str | None = None
) -> list[str]:
    """Writes summaries of the generations that have none for this spec and so many rows; returns their names."""
    folder = f"{store}/{family(spec, mode, on_bad_date)}"
    live = manifest.live_sources(spark, table_dir).where("n_rows > 0")
    new = []
    for gen in sorted(r.gen for r in live.select("gen").distinct().collect()):
        path, there = manifest.folder(spark, f"{folder}/gen={gen}/facts")
        if there.exists(path):
            facts = spark.read.schema(FACTS).parquet(f"{folder}/gen={gen}/facts").collect()
            if all(f.asked >= spec.wanted[f["class"]] or f.bound == ALL for f in facts):
                continue
            there.delete(path.getParent(), True)
        data = f"{table_dir}/data"
        rows = spark.read.schema(TABLE_SCHEMA).option("basePath", data).parquet(f"{data}/gen={gen}")
        candidates = collect.candidates(rows, spec, mode, on_bad_date)
        scored = candidates.withColumn("_least", least_score(spec.random_seed, "sha256"))
        # a hash that two keys share only makes this larger
        most = candidates.groupBy("class", F.xxhash64(copies.key_text("sha256")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        most = {r["class"]: r.n for r in most.groupBy("class").agg(F.max("n").alias("n")).collect()}
        bounds = _bounds(scored, spec.wanted)
        # a generation in which a key has too many rows by itself is drawn from as it is
        kept = [
            scored.where((F.col("class") == cls) & (F.col("_least") <= bounds[cls]))
            for cls in CLASSES
            if most.get(cls, 0) <= COPIES
        ]
        hidden = f"{folder}/_new-{uuid.uuid4().hex}"
        if kept:
            reduce(DataFrame.unionByName, kept).drop("gen").write.parquet(f"{hidden}/rows")
        facts = [(cls, bounds[cls], most.get(cls, 0), spec.wanted[cls]) for cls in CLASSES]
        spark.createDataFrame(facts, FACTS).coalesce(1).write.parquet(f"{hidden}/facts")
        manifest.renamed(spark, hidden, f"{folder}/gen={gen}")
        new.append(gen)
    return new


def sample_from_summaries(
    spark: SparkSession, table_dir: str, store: str, spec: CollectionSpec, mode: str = "collect", on_bad_date: str | None = None
) -> DataFrame | None:
    """The table's sample by way of its summaries, which are brought up to date; None where they cannot tell."""
    if spec.random_seed is None:
        raise ValueError("an unseeded sample has no summaries; call with_seed() first")
    summarise(spark, table_dir, store, spec, mode, on_bad_date)
    folder = f"{store}/{family(spec, mode, on_bad_date)}"
    live = manifest.live_sources(spark, table_dir).where("n_rows > 0").select("gen", "source_id")
    gens = [r.gen for r in live.select("gen").distinct().collect()]
    if not gens:
        return collect.collect_sample(catalog.read_table(spark, table_dir), spec, mode, on_bad_date)
    facts = reduce(DataFrame.unionByName, [spark.read.schema(FACTS).parquet(f"{folder}/gen={g}/facts") for g in gens])
    facts = {r["class"]: r for r in facts.groupBy("class").agg(F.sum("most").alias("most"), F.min("bound").alias("bound")).collect()}
    if any(f.most > COPIES for f in facts.values()):
        return None
    columns = TABLE_SCHEMA.fieldNames()
    kept = [spark.read.parquet(f"{folder}/gen={g}/rows").withColumn("gen", F.lit(g)) for g in gens]
    rows = reduce(DataFrame.unionByName, kept).join(live, ["gen", "source_id"], "left_semi")
    bound = F.create_map(*[F.lit(x) for cls in CLASSES for x in (cls, facts[cls].bound)])
    rows = rows.where(F.col("_least") <= bound[F.col("class")]).select("class", *columns)
    drawn = sampling.draw(rows, spec.wanted, spec.random_seed, keep_score=True)
    last = {r["class"]: (r.n, r.last) for r in drawn.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.max("_score").alias("last")).collect()}
    for cls, n in spec.wanted.items():
        got, score = last.get(cls, (0, ""))
        if facts[cls].bound != ALL and (got < n or score[:DIGITS] > facts[cls].bound):
            return None
    return drawn.drop("_score")


def collect_sample(
    spark: SparkSession, table_dir: str, store: str, spec: CollectionSpec, mode: str = "collect", on_bad_date: str | None = None
) -> DataFrame:
    """``collect.collect_sample`` of the table, from summaries where these can tell."""
    spec = spec.with_seed()
    sample = sample_from_summaries(spark, table_dir, store, spec, mode, on_bad_date)
    if sample is None:
        sample = collect.collect_sample(catalog.read_table(spark, table_dir), spec, mode, on_bad_date)
    return sample
