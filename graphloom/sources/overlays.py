"""Graph collections over the driver tables: orders as graphs, labelled vectors as graphs, the toy fixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.residues import DESCRIPTORS

RESIDUES = list(DESCRIPTORS)
NEWEST = ["l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as node rows before duplicates of (order, part) are resolved."""
    return _rows(table(spark, sf_dir, "lineitem"))


def _rows(lines: DataFrame) -> DataFrame:
    chain = F.char(F.lit(65) + F.floor(F.col("l_partkey") / 500) % 26)
    residue = F.get(F.array(*map(F.lit, RESIDUES)), (F.col("l_partkey") % 21).cast("int"))
    return lines.select(
        F.concat(F.lit("O"), F.col("l_orderkey").cast("string")).alias("graph_code"), F.col("l_orderkey").alias("seq"),
        F.concat_ws(":", chain, residue, F.col("l_partkey").cast("string")).alias("node_label"),
        F.array("l_quantity", F.col("l_discount") * 100, F.col("l_tax") * 100).alias("coords"), F.col("l_extendedprice").alias("b_factor"),
        F.struct(*NEWEST).alias("version"),
    )


def order_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest nodes: graph_code, seq, pos, node_label, coords, b_factor. The newest duplicate wins.

    Lines are shuffled once, by order and before labels are made of their numbers.
    """
    rows = _rows(table(spark, sf_dir, "lineitem").repartition("l_orderkey"))
    newest = rows.groupBy("graph_code", "seq", "node_label").agg(F.max_by(F.struct("coords", "b_factor"), "version").alias("last"))
    pos = F.row_number().over(Window.partitionBy("seq").orderBy("node_label")) - 1
    return newest.select("graph_code", "seq", pos.cast("long").alias("pos"), "node_label", F.col("last.coords").alias("coords"), F.col("last.b_factor").alias("b_factor"))


def order_edges(nodes: DataFrame) -> DataFrame:
    """Ingest edges: all pairs of an order, with kinds by rule. A seq has one code, so that pairs and their places come from one shuffle of the nodes."""
    from graphloom.operators.construct import distance

    side = lambda s: nodes.select("graph_code", "seq", F.col("node_label").alias(s), F.col("coords").alias(f"{s}_at"))
    pairs = side("u").join(side("v").drop("graph_code").hint("merge"), "seq").filter("u < v").withColumn("distance", distance("u_at", "v_at"))
    same = F.split("u", ":")[0] == F.split("v", ":")[0]
    kinds = F.array_compact(F.array(F.lit("fully_connected"), F.when(F.col("distance") <= 6, "near"), F.when(same, "same_chain")))
    pos = F.row_number().over(Window.partitionBy("seq").orderBy("u", "v")) - 1
    return pairs.select("graph_code", "seq", pos.cast("long").alias("pos"), "u", "v", "distance", kinds.alias("kinds"))


def vector_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label form a graph; nodes are vec_id with the first three dimensions."""
    at = [F.get("embedding", F.lit(i)).cast("double") for i in range(3)]
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("graph_id"), F.col("vec_id").alias("node_id"), F.array(*at).alias("coords"))


# Two hand-made graphs of five atoms and four edges.
_TOY = {
    "1BXL": (["A:ALA:89:N", "A:ALA:89:CA", "A:GLN:88:C", "A:ALA:89:C", "A:ALA:89:CB"], [(0, 1), (0, 2), (1, 3), (1, 4)]),
    "1G5J": (["A:ALA:89:N", "A:ALA:89:CA", "A:GLU:48:C", "A:ALA:89:C", "A:ALA:89:CB"], [(0, 1), (0, 2), (1, 3), (1, 4)]),
}


def toy(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the toy collection; positions and lengths are made up, all different."""
    nodes, edges = [], []
    for seq, (code, (labels, pairs)) in enumerate(_TOY.items()):
        for i, label in enumerate(labels):
            nodes.append((code, seq, i, label, [float(seq), float(i), i / 2], float(10 * seq + i % 4)))
        for i, (a, b) in enumerate(pairs):
            edges.append((code, seq, i, labels[a], labels[b], 1.0 + seq + i / 10, ["covalent"]))
    return (
        spark.createDataFrame(nodes, "graph_code string, seq long, pos long, node_label string, coords array<double>, b_factor double"),
        spark.createDataFrame(edges, "graph_code string, seq long, pos long, u string, v string, distance double, kinds array<string>"),
    )
