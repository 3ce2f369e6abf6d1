"""The k nearest nodes of a graph by growing cells.

Space is cut into cells whose width starts from the density of the graph. Each node meets the nodes
of the 27 cells around it; once its k-th nearest is no farther than a cell is wide, no other node
can be nearer, and the node is done. The others go on with cells twice as wide, until a cell is as
wide as the graph. Cells with many nodes are dealt out by salts, so neither a dense place nor a graph
of any size ends up in one task, and graphs are never joined with themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import settled
from .skew import by_group

CELL = 4096  # nodes of a cell that one salt takes
AXES = ("x", "y", "z")


def boxes(points: DataFrame) -> DataFrame:
    """graph_id, n, and low_ and span_ of each axis."""
    ends = [f(c).alias(f"{name}_{c}") for c in AXES for name, f in (("low", F.min), ("high", F.max))]
    return points.groupBy("graph_id").agg(F.count("*").alias("n"), *ends).select("graph_id", "n", *[f"low_{c}" for c in AXES], *[(F.col(f"high_{c}") - F.col(f"low_{c}")).alias(f"span_{c}") for c in AXES])


def start_width(k: int) -> Column:
    """The width of a cell that holds k + 1 nodes if they are spread evenly over the axes that the graph extends in."""
    spans = [F.col(f"span_{c}") for c in AXES]
    wide = [(s > 0).cast("int") for s in spans]
    volume = reduce(lambda a, b: a * b, [F.when(s > 0, s).otherwise(1.0) for s in spans])
    dimensions = F.greatest(F.lit(1), sum(wide[1:], wide[0]))
    width = F.pow(volume * (k + 1) / F.col("n"), 1 / dimensions)
    longest = F.greatest(*spans)
    # a cell index stays well inside 64 bits, and a graph in one place has one cell
    return F.when(longest == 0, 1.0).otherwise(F.least(F.greatest(width, longest / (1 << 40)), longest))


def nearest(nodes: DataFrame, k: int, extra: list[str], allowed: Column | None = None) -> DataFrame:
    """graph_id, u, v, distance of the k nearest v of each u (all, if fewer), ties to the smaller id.

    ``nodes`` have finite coordinates. ``extra`` columns are there as u_ and v_ for the condition
    ``allowed``, which a neighbour has to meet.
    """
    points = settled(nodes.select("graph_id", "node_id", *[F.get("coords", F.lit(i)).alias(c) for i, c in enumerate(AXES)], *extra), "points")
    boxed = settled(boxes(points).withColumn("width", start_width(k)), "boxes")
    points = by_group(points, boxed, ["graph_id"], "n")
    points = settled(points.withColumn("span", F.greatest(*[f"span_{c}" for c in AXES])).drop("n", *[f"span_{c}" for c in AXES]), "placed")
    active, found, step = points, [], 1
    while True:
        width = F.col("width") * step
        cell = lambda c: F.floor((F.col(c) - F.col(f"low_{c}")) / width).alias(f"c_{c}")  # noqa: B023, E731
        held = points.select("graph_id", F.col("node_id").alias("v"), *[cell(c) for c in AXES], *[F.col(c).alias(f"v_{c}") for c in (*AXES, *extra)])
        cells = ["graph_id", *[f"c_{c}" for c in AXES]]
        parts = settled(held.groupBy(cells).agg(F.count("*").alias("n"), F.ceil(F.count("*") / CELL).alias("salts")), "cells")
        salted = by_group(held, parts, cells, "n").withColumn("salt", F.pmod(F.xxhash64("v"), F.col("salts"))).drop("n", "salts")
        asking = active.select("graph_id", F.col("node_id").alias("u"), (width * (1 - 1e-9)).alias("reach"), (F.col("span") <= width).alias("all"), *[cell(c) for c in AXES], *[F.col(c).alias(f"u_{c}") for c in (*AXES, *extra)])
        for c in AXES:
            asking = asking.withColumn(f"c_{c}", F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda s: F.col(f"c_{c}") + s)))  # noqa: B023
        asking = asking.join(parts.drop("n"), cells).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
        met = asking.join(salted, [*cells, "salt"]).filter("u <> v")
        met = met if allowed is None else met.filter(allowed)
        d = [F.col(f"u_{c}") - F.col(f"v_{c}") for c in AXES]
        met = met.select("graph_id", "u", "v", "reach", "all", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).alias("distance"))
        by = Window.partitionBy("graph_id", "u")
        first = met.withColumn("rank", F.row_number().over(by.orderBy("distance", "v"))).filter(F.col("rank") <= k)
        last = F.max(F.when(F.col("rank") == k, F.col("distance"))).over(by)
        near = settled(first.withColumn("done", F.coalesce(F.col("all") | (last <= F.col("reach")), F.lit(False))), "near")
        found.append(near.filter("done").select("graph_id", "u", "v", "distance"))
        done = near.filter("done").select("graph_id", F.col("u").alias("node_id")).distinct()
        # a node alone in its graph meets nobody, and leaves once its cell is as wide as the graph
        active = settled(active.filter(F.col("span") > width).join(done, ["graph_id", "node_id"], "left_anti"), "active")
        if active.isEmpty():
            return reduce(DataFrame.unionByName, found)
        step *= 2
