"""Kernels that feed graph learning: edge indices, batched edge lists, features, segment and message aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def local_index(nodes: DataFrame) -> DataFrame:
    """nodes with ``index``: 0, 1, ... by node_id inside each graph."""
    return nodes.withColumn("index", (F.row_number().over(Window.partitionBy("graph_id").orderBy("node_id")) - 1).cast("long"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.withColumnsRenamed({"u": "_v", "v": "u"}).withColumnRenamed("_v", "v"))


def edge_index(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, source, target: two rows an undirected edge, ends as local indices."""
    at = local_index(nodes).select("graph_id", "node_id", "index")
    out = both_ways(edges.select("graph_id", "u", "v"))
    out = out.join(at.withColumnsRenamed({"node_id": "u", "index": "source"}), ["graph_id", "u"]).join(at.withColumnsRenamed({"node_id": "v", "index": "target"}), ["graph_id", "v"])
    return out.select("graph_id", "source", "target")


def complete_edges(sizes: DataFrame) -> DataFrame:
    """graph_id, source, target for all i <> j of n nodes; sizes: (graph_id, n)."""
    ids = lambda: F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    return sizes.filter("n > 0").withColumn("source", ids()).withColumn("target", ids()).filter("source <> target").select("graph_id", "source", "target")


def batched(edges: DataFrame, n: int | str, batch_size: int) -> DataFrame:
    """batch, source, target, weight and other columns: edge lists repeated with indices offset by n (a number or a column) a repetition."""
    n = F.col(n) if isinstance(n, str) else F.lit(n)
    others = [c for c in edges.columns if c not in ("source", "target")]
    repeated = edges.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(batch_size - 1).cast("long"))).alias("batch"))
    return repeated.select(*others, "batch", (F.col("source") + n * F.col("batch")).alias("source"), (F.col("target") + n * F.col("batch")).alias("target"), F.lit(1.0).alias("weight"))


def features(*arrays: str):
    """One feature vector of several."""
    return F.concat(*arrays)


def radial(nodes: DataFrame, edges: DataFrame, normalise: bool = False) -> DataFrame:
    """graph_id, u, v, radial [, diff]: squared distance of the ends, and their difference over (distance + 1e-8)."""
    at = nodes.select("graph_id", "node_id", "coords")
    out = edges.join(at.withColumnsRenamed({"node_id": "u", "coords": "a"}), ["graph_id", "u"]).join(at.withColumnsRenamed({"node_id": "v", "coords": "b"}), ["graph_id", "v"])
    d = [F.get("a", F.lit(i)) - F.get("b", F.lit(i)) for i in range(3)]
    squared = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
    columns = ["graph_id", "u", "v", squared.alias("radial")]
    return out.select(*columns, F.array(*[x / (F.sqrt(squared) + 1e-8) for x in d]).alias("diff")) if normalise else out.select(*columns)


def segment_sum(df: DataFrame, segments: DataFrame, key: str, value: str) -> DataFrame:
    """key, total: 0 for segments without rows."""
    return segments.join(df.groupBy(key).agg(F.sum(value).alias("total")), key, "left").select(key, F.coalesce("total", F.lit(0.0)).alias("total"))


def segment_mean(df: DataFrame, segments: DataFrame, key: str, value: str) -> DataFrame:
    """key, mean: sum over the number of rows, at least 1."""
    per = df.groupBy(key).agg(F.sum(value).alias("t"), F.count(value).alias("n"))
    return segments.join(per, key, "left").select(key, (F.coalesce("t", F.lit(0.0)) / F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))).alias("mean"))


def pool(nodes: DataFrame, how: str = "mean", width: int = 3) -> DataFrame:
    """graph_id and one vector a graph: the sum or mean of its nodes' coords."""
    f = {"add": F.sum, "mean": F.avg}[how]
    return nodes.groupBy("graph_id").agg(*[f(F.get("coords", F.lit(i))).alias(f"x{i}") for i in range(width)])


def message_round(nodes: DataFrame, edges: DataFrame, how: str = "mean", width: int = 3) -> DataFrame:
    """One round of neighbour aggregation: graph_id, node_id, x0..: mean or sum over neighbours, 0 without any."""
    f = {"add": F.sum, "mean": F.avg}[how]
    sent = both_ways(edges.select("graph_id", "u", "v")).join(nodes.select("graph_id", F.col("node_id").alias("v"), "coords"), ["graph_id", "v"])
    got = sent.groupBy("graph_id", F.col("u").alias("node_id")).agg(*[f(F.get("coords", F.lit(i))).alias(f"x{i}") for i in range(width)])
    return nodes.select("graph_id", "node_id").join(got, ["graph_id", "node_id"], "left").select("graph_id", "node_id", *[F.coalesce(f"x{i}", F.lit(0.0)).alias(f"x{i}") for i in range(width)])


def normalised_round(nodes: DataFrame, edges: DataFrame, width: int = 3) -> DataFrame:
    """Neighbour aggregation with self-loops, weighted by 1 / sqrt(degree of both ends): graph_id, node_id, x0.."""
    sent = both_ways(edges.select("graph_id", "u", "v")).unionByName(nodes.select("graph_id", F.col("node_id").alias("u"), F.col("node_id").alias("v")))
    degree = sent.groupBy("graph_id", F.col("u").alias("node_id")).agg(F.count("*").alias("d"))
    at = nodes.select("graph_id", "node_id", "coords").join(degree, ["graph_id", "node_id"])
    sent = sent.join(at.select("graph_id", F.col("node_id").alias("v"), "coords", F.col("d").alias("dv")), ["graph_id", "v"])
    got = sent.groupBy("graph_id", F.col("u").alias("node_id")).agg(*[F.sum(F.get("coords", F.lit(i)) / F.sqrt("dv")).alias(f"x{i}") for i in range(width)])
    return got.join(degree, ["graph_id", "node_id"]).select("graph_id", "node_id", *[(F.col(f"x{i}") / F.sqrt("d")).alias(f"x{i}") for i in range(width)])


def attention_round(nodes: DataFrame, edges: DataFrame, width: int = 3) -> DataFrame:
    """Neighbour aggregation weighted by the softmax of the ends' dot product: graph_id, node_id, x0..; 0 without neighbours."""
    side = lambda end: nodes.select("graph_id", F.col("node_id").alias(end), F.col("coords").alias(f"{end}_at"))
    sent = both_ways(edges.select("graph_id", "u", "v")).join(side("u"), ["graph_id", "u"]).join(side("v"), ["graph_id", "v"])
    dot = sum((F.get("u_at", F.lit(i)) * F.get("v_at", F.lit(i)) for i in range(width)), F.lit(0.0))
    top = Window.partitionBy("graph_id", "u")
    weighed = sent.withColumn("dot", dot).withColumn("w", F.exp(F.col("dot") - F.max("dot").over(top)))
    got = weighed.groupBy("graph_id", F.col("u").alias("node_id")).agg(*[(F.sum(F.col("w") * F.get("v_at", F.lit(i))) / F.sum("w")).alias(f"x{i}") for i in range(width)])
    return nodes.select("graph_id", "node_id").join(got, ["graph_id", "node_id"], "left").select("graph_id", "node_id", *[F.coalesce(f"x{i}", F.lit(0.0)).alias(f"x{i}") for i in range(width)])


def equivariant_round(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The coordinate part of an E(n)-equivariant round with unit weights: x + mean of normalised differences."""
    sent = radial(nodes, both_ways(edges.select("graph_id", "u", "v")), normalise=True)
    moved = sent.groupBy("graph_id", F.col("u").alias("node_id")).agg(*[F.avg(F.get("diff", F.lit(i))).alias(f"d{i}") for i in range(3)])
    return nodes.select("graph_id", "node_id", "coords").join(moved, ["graph_id", "node_id"], "left").select("graph_id", "node_id", *[(F.get("coords", F.lit(i)) + F.coalesce(f"d{i}", F.lit(0.0))).alias(f"x{i}") for i in range(3)])
