"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievecraft.scratch import staged


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node that it reaches) for every node of ``edges`` (a, b: long).

    In each round every label takes the smallest label next to it, twice over, and the edges are rewritten to the new
    labels; edges inside a label go. A round at least halves the labels of a connected part that are not its smallest, so
    few rounds do. Every table is written between rounds, so that both sides of each join are plain shuffles, which Spark
    splits where one label holds most rows. Loops and nulls are ignored; repeated edges do no harm.
    """
    ends = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = staged(edges.where("a <> b").select(*ends).distinct(), "edges")
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    labels = staged(nodes.withColumn("component", F.col("node")), "labels")
    while not edges.isEmpty():
        near = edges.select(F.col("a").alias("from"), F.col("b").alias("to"))
        near = near.unionByName(edges.select(F.col("b").alias("from"), F.col("a").alias("to")))
        parents = near.groupBy("from").agg(F.min("to").alias("to"))
        parents = staged(parents.select("from", F.least("from", "to").alias("to")), "parents")
        above = parents.select(F.col("from").alias("to"), F.col("to").alias("top"))
        jumped = staged(parents.join(above, "to").select("from", F.col("top").alias("to")), "jumped")
        labels = labels.join(jumped, labels["component"] == jumped["from"], "left").select(
            "node", F.coalesce("to", "component").alias("component")
        )
        labels = staged(labels, "labels")
        for end in ("a", "b"):
            other = "b" if end == "a" else "a"
            edges = edges.join(jumped, edges[end] == jumped["from"]).select(F.col("to").alias(end), other)
        edges = staged(edges.where("a <> b").select(*ends).distinct(), "edges")
    return labels
