"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, component) of every node with a link; the component is its smallest node. links: (a, b) of bigint.

    Each round gives every node the smallest label among its neighbours' and then that label's own label, so that the
    rounds follow the logarithm of the longest chain. Labels are written between rounds. Neighbours' labels are summed up
    before they are shuffled, and the join of links to labels can be split where a node has very many links.
    """
    both = staged(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("component")))
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node", "left").select(
            "node", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("new")
        )
        roots = labels.select(F.col("node").alias("new"), F.col("component").alias("root"))
        moved = staged(lower.join(roots, "new", "left").select("node", "old", F.least("new", F.coalesce("root", "new")).alias("component")))
        labels = moved.select("node", "component")
        if moved.where("old <> component").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def extended(linked: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after more links (a, b) are added to those of ``linked``; only components that a new link joins are worked on.

    Links become links between the components so far, whose components then rename them.
    """
    ends = links.select("a", "b").where("a <> b")
    for x in ("a", "b"):
        known = linked.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
        ends = ends.join(known, x, "left").withColumn(f"c{x}", F.coalesce(f"c{x}", x))
    ends = staged(ends)
    new = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
    fresh = ends.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("ca").alias("component")), F.struct(F.col("b").alias("node"), F.col("cb").alias("component")))).alias("x"))
    every = linked.select("node", "component").union(fresh.select("x.node", "x.component")).distinct()
    renamed = new.select(F.col("node").alias("component"), F.col("component").alias("lower"))
    return staged(every.join(renamed, "component", "left").select("node", F.coalesce("lower", "component").alias("component")))
