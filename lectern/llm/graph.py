"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node it is joined to.

    Each round points every node at its smallest neighbour, follows pointers by
    doubling until all reach a root, and contracts the links to those between
    roots. Links, pointers and labels stay tables and are checkpointed each round.
    """
    links = links.where("a is not null and b is not null and a <> b")
    edges = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = None
    while not edges.isEmpty():
        up = cut(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")))
        moving = True
        while moving:
            above = up.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            step = cut(up.join(above, "p").select("a", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")))
            moving = not step.where("moved").isEmpty()
            up = step.select("a", "p")
        if labels is None:
            labels = up
        else:
            after = up.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            labels = cut(labels.join(after, "p", "left").select("a", F.coalesce("pp", "p").alias("p")))
        left = up.select("a", F.col("p").alias("pa"))
        right = up.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        edges = cut(edges.join(left, "a").join(right, "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct())
    if labels is None:
        labels = edges.select("a", F.col("b").alias("p"))
    return labels.select(F.col("a").alias("node"), F.col("p").alias("root"))
