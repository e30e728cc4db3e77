"""Connected components of a link table, in Spark rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import materialize


def connected_components(links: DataFrame, a: str = "a", b: str = "b", distinct: bool = True) -> DataFrame:
    """``node``, ``component`` (the smallest node reachable) for every node of a link with another.

    Each round a node takes the smallest label among its own and its neighbours', then the label of that label; links
    are drawn anew between labels, and those within one label go. So the links shrink fast, and the rounds grow
    with the logarithm of the longest chain. The neighbours' minimum is combined per map task, so a node with very many
    links is no hot task. Without ``distinct`` repeated links stay for the first round, for links that hardly repeat. Each round is written to the shared folder, which cuts the lineage.
    """
    edges = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    edges = materialize(edges.distinct() if distinct else edges, "edges")
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
        jump = near.select(F.col("node").alias("label"), F.col("label").alias("next"))
        step = materialize(near.join(jump, "label").select("node", F.col("next").alias("label")), "labels")
        if found is None:
            found = step
        else:
            then = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
            found = materialize(found.join(then, "label", "left").select("node", F.coalesce("next", "label").alias("label")), "labels")
        ends = edges.join(step.toDF("a", "la"), "a").join(step.toDF("b", "lb"), "b")
        edges = materialize(ends.where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return found.withColumnRenamed("label", "component")
