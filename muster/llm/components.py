"""Connected components of a table of links, by label spreading with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.session import materialise


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root`` for every node with a link: the smallest node that can be reached.

    Each round takes the least label among a node's neighbours and then the label of that label, so the number of
    rounds follows the logarithm of the longest path in practice.  The labels of a round are a written table: plans
    stay small and a lost executor costs one round at most.  Only a count comes to the driver.
    """
    ends = links.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = ends.unionByName(ends.select(F.col("other").alias("node"), F.col("node").alias("other")))
    given = materialise(both.where("node <> other").distinct(), "links")
    # Each node's larger neighbours go to its smallest one: what was connected stays so, and a dense group becomes a star.
    smallest = given.groupBy("node").agg(F.least(F.first("node"), F.min("other")).alias("to"))
    star = given.where("other > node").join(smallest, "node").select(F.col("other").alias("node"), F.col("to").alias("other"))
    star = star.distinct()
    edges = materialise(
        star.unionByName(star.select(F.col("other").alias("node"), F.col("node").alias("other"))), "star"
    )
    labels = materialise(
        edges.groupBy("node").agg(F.least(F.first("node"), F.min("other")).alias("root")), "labels"
    )
    while True:
        near = (
            edges.join(labels.withColumnRenamed("node", "other"), "other")
            .groupBy("node").agg(F.min("root").alias("near"))
        )
        jumped = labels.select(F.col("node").alias("root"), F.col("root").alias("far"))
        moved = (
            labels.join(near, "node").join(jumped, "root")
            .select("node", F.least("root", "near", "far").alias("new"), F.col("root").alias("old"))
        )
        step = materialise(moved, "labels")
        changed = not step.where("new <> old").isEmpty()
        labels = step.select("node", F.col("new").alias("root"))
        if not changed:
            return labels
