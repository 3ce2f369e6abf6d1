"""Sizes, redundancy, footprint, summaries of measurements, and classification metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.units import mib

from .lineage import settled
from .store import GraphStore


def graph_sizes(store: GraphStore) -> DataFrame:
    """graph_id, graph_code, seq, n_nodes, n_edges; a graph without edges has 0."""
    nodes = store.graph_nodes.groupBy("graph_id").agg(F.count("*").alias("n_nodes"))
    edges = store.graph_edges.groupBy("graph_id").agg(F.count("*").alias("n_edges"))
    zero = F.lit(0).cast("long")
    return store.graphs.join(nodes.hint("merge"), "graph_id", "left").join(edges.hint("merge"), "graph_id", "left").select("graph_id", "graph_code", "seq", F.coalesce("n_nodes", zero).alias("n_nodes"), F.coalesce("n_edges", zero).alias("n_edges"))


def extremes(sizes: DataFrame) -> DataFrame:
    """One row: smallest and largest graph by edges and by nodes; ties go to the first inserted."""
    low = lambda c: F.min_by("graph_code", F.struct(c, "seq"))
    high = lambda c: F.max_by("graph_code", F.struct(F.col(c), -F.col("seq")))
    return sizes.agg(
        F.min("n_edges").alias("min_edges"), F.max("n_edges").alias("max_edges"), F.min("n_nodes").alias("min_nodes"), F.max("n_nodes").alias("max_nodes"),
        low("n_nodes").alias("smallest"), high("n_nodes").alias("largest"),
    )


def totals(sizes: DataFrame) -> DataFrame:
    return sizes.agg(F.count("*").alias("n_graphs"), F.coalesce(F.sum("n_nodes"), F.lit(0)).alias("n_nodes"), F.coalesce(F.sum("n_edges"), F.lit(0)).alias("n_edges"))


def redundancy(store: GraphStore) -> DataFrame:
    """One row: memberships, dictionary entries and 1 - entries / memberships, for nodes and edges."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    one = count(store.graph_nodes, "node_rows").crossJoin(count(store.node_dict, "node_labels")).crossJoin(count(store.graph_edges, "edge_rows")).crossJoin(count(store.edge_dict, "edge_labels"))  # four single rows
    return one.select("*", (1 - F.col("node_labels") / F.col("node_rows")).alias("node_redundancy"), (1 - F.col("edge_labels") / F.col("edge_rows")).alias("edge_redundancy"))


def _width(df: DataFrame, c: str) -> Column:
    kind = df.schema[c].dataType.simpleString()
    if kind in ("string", "binary"):
        return F.coalesce(F.octet_length(c), F.lit(0))
    if kind == "array<string>":
        return F.coalesce(F.aggregate(c, F.lit(0), lambda s, x: s + F.octet_length(x)), F.lit(0))
    if kind.startswith("array"):
        return 8 * F.greatest(F.size(c), F.lit(0))
    return F.lit(4 if kind == "int" else 8)


def footprint(tables: dict[str, DataFrame]) -> DataFrame:
    """part, rows, bytes (logical: octets of strings, eight a number), mib. Parts are measured one after the other, so that what one shuffles goes before the next."""
    out = []
    for part, df in tables.items():
        size = sum((_width(df, c) for c in df.columns), F.lit(0)).cast("long")
        row = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(size), F.lit(0).cast("long")).alias("bytes")).select(F.lit(part).alias("part"), "rows", "bytes", mib(F.col("bytes")).alias("mib"))
        out.append(row)
    return settled(out, "footprint")


def rolled_up(parts: DataFrame) -> DataFrame:
    """Sums over parts: structure, node attributes, edge attributes, total; the node dictionary is in the total."""
    group = F.when(F.col("part").isin("graphs", "node_dict", "edge_dict"), "structure").when(F.col("part") == "graph_nodes", "node_attributes").otherwise("edge_attributes")
    return parts.groupBy(F.coalesce(group, F.lit("")).alias("part")).agg(F.sum("bytes").alias("bytes")).unionByName(parts.agg(F.sum("bytes").alias("bytes")).select(F.lit("total").alias("part"), "bytes"))


def serialized(df: DataFrame) -> DataFrame:
    """(files, bytes) that a Parquet table takes on disk."""
    files = df.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("n")).distinct()
    return files.agg(F.count("*").alias("files"), F.sum("n").alias("bytes"))


def savings(raw: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: bytes of both and 1 - stored / raw."""
    total = lambda df, name: df.agg(F.sum("bytes").alias(name))
    return total(raw, "raw_bytes").crossJoin(total(stored, "stored_bytes")).withColumn("saving", 1 - F.col("stored_bytes") / F.col("raw_bytes"))  # two single rows


def timing(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def faster(a: Column, b: Column, names: tuple[str, str]) -> list[Column]:
    """The faster of two means and by how much of the slower it is faster."""
    return [F.when(a <= b, names[0]).otherwise(names[1]).alias("faster"), (1 - F.least(a, b) / F.greatest(a, b)).alias("improvement")]


def accuracy(df: DataFrame, y: str, pred: str) -> DataFrame:
    return df.agg(F.avg((F.col(y) == F.col(pred)).cast("int")).alias("accuracy"))


def weighted_f1(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Class F1 weighted by the number of true rows; classes come from one pass over both columns."""
    sides = df.select(F.explode(F.array(F.struct(F.col(y).alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p"), F.lit(0).alias("hit")), F.struct(F.col(pred).alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p"), (F.col(y) == F.col(pred)).cast("int").alias("hit")))).alias("s")).select("s.*")
    per = sides.groupBy("c").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("hit").alias("hit"))
    return per.agg((F.sum(F.col("t") * 2 * F.col("hit") / (F.col("t") + F.col("p"))) / F.sum("t")).alias("weighted_f1"))


def argmax(scores: Column) -> Column:
    return F.array_position(scores, F.array_max(scores)) - 1


def mean_loss(df: DataFrame, scores: str, y: str) -> DataFrame:
    """loss: the mean cross-entropy of a softmax over the scores (an array) at the class y."""
    top = F.array_max(scores)
    spread = F.aggregate(scores, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return df.agg(F.avg(top + F.log(spread) - F.get(scores, F.col(y).cast("int"))).alias("loss"))
