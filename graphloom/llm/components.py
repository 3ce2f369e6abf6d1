"""Connected components of a link table, by rounds of smallest-label exchange with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) for every node of edges (a, b); label is the smallest node of its component.

    Every round is a written table, so a lost executor costs one task. Nothing goes to the driver
    but the number of labels that changed. Null ends are left out; an empty table gives none.
    """
    both = edges.filter("a is not null and b is not null and a <> b")
    both = saved(both.select("a", "b").union(both.select("b", "a")).distinct(), "links")
    labels = saved(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label")), "labels")
    for _ in range(rounds):
        around = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("low"))
        met = labels.join(around.withColumnRenamed("a", "node"), "node").select("node", F.least("label", "low").alias("next"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("further"))
        labels = saved(met.join(jump, "next", "left").select("node", F.least("next", "further").alias("label"), "was"), "labels")
        if labels.filter("label <> was").limit(1).count() == 0:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return labels.select("node", "label")
