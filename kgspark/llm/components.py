"""Connected components of links, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` (smallest node of its component) for every node with a link.

    Each round a node takes the smallest label among itself and its neighbours, then the label of its label; so paths shrink by
    half. Links inside one component are dropped as soon as their ends agree. A hub's links are aggregated before they are
    shuffled. Rounds go on until no label changes.
    """
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    both = cut_lineage(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    label = cut_lineage(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("l")))
    while True:
        seen = both.join(label.select(F.col("u").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("m"))
        near = label.join(seen, "u").select("u", F.least("l", "m").alias("l"), F.col("l").alias("old"))
        # the label of the label: labels are nodes themselves
        far = label.select(F.col("u").alias("l"), F.col("l").alias("ll"))
        jumped = cut_lineage(near.join(far, "l").select("u", F.least("l", "ll").alias("l"), "old"))
        moved = not jumped.filter("l <> old").isEmpty()
        label = jumped.select("u", "l")
        if not moved:
            return label.select(F.col("u").alias("node"), F.col("l").alias("component"))
