"""A job: code list and structure files in, a stored collection, sizes and errors out.

    python -m graphloom.plans.build_job CODES STRUCTURES OUT [FUNCTION ...]

Settings that aren't given come from the environment: ``DATASET`` names the code list inside
``DATA_DIR``, ``EXCOUNT`` other than 0 appends to earlier results. A code without a readable
structure is a row of the error table and nothing else; it never stands for another code.
"""

from __future__ import annotations

import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import labels
from graphloom.operators import construct, stats
from graphloom.operators.encode import dense
from graphloom.operators.lineage import settled
from graphloom.operators.store import GraphStore, Meta
from graphloom.sources import files, sinks

FUNCTIONS = ("delaunay", "aromatic", "aromatic_sulphur")


def collection(codes: DataFrame, atoms: DataFrame, functions: tuple[str, ...] = FUNCTIONS, granularity: str = "CA") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, errors) in ingest form of the codes that atoms has; seq is the order of the code list, first line of a code first."""
    wanted = codes.filter("code <> ''").groupBy("code").agg(F.min(F.struct(*files.LINE)).alias("_first"))
    ordered = settled(dense(wanted.select("code", "_first.*"), files.LINE, "seq").select(F.col("code").alias("graph_code"), "seq"), "ordered")
    nodes = settled(files.raw_nodes(atoms, granularity, order=ordered), "atoms")
    points = nodes.select(F.col("seq").alias("graph_id"), F.col("node_label").alias("node_id"), "coords", *labels.parsed(F.col("node_label"), granularity))
    built = construct.combine(points, [construct.registry[f] for f in functions])
    built = built.join(ordered.withColumnRenamed("seq", "graph_id"), "graph_id")
    edges = built.select("graph_code", F.col("graph_id").alias("seq"), F.xxhash64("u", "v").alias("pos"), "u", "v", "distance", "kinds")
    errors = ordered.join(nodes.select("graph_code").distinct(), "graph_code", "left_anti").select(F.col("graph_code").alias("code"), F.lit("no structure, or none of its atoms is of the granularity").alias("message"))
    return nodes.select("graph_code", "seq", "pos", "node_label", "coords", "b_factor"), edges, errors


def run(spark: SparkSession, codes: str, structures: str, out: str, functions: tuple[str, ...] = FUNCTIONS, granularity: str = "CA", append: bool = False) -> GraphStore:
    nodes, edges, errors = collection(files.code_list(spark, codes), files.structures(spark, structures), functions, granularity)
    meta = Meta(granularity, tuple((f, "{}") for f in functions))
    GraphStore.build(nodes, settled(edges, "edges"), meta).write(f"{out}/store")
    store = GraphStore.read(spark, f"{out}/store")
    sizes = stats.graph_sizes(store)
    sinks.results(stats.extremes(sizes).crossJoin(stats.totals(sizes)).withColumn("dataset", F.lit(os.path.basename(codes))), f"{out}/results", append)  # two single rows
    sinks.errors(errors, f"{out}/errors")
    return store


def main(args: list[str]) -> None:
    data = os.environ.get("DATA_DIR", ".")
    codes = args[0] if args else f"{data}/{os.environ['DATASET']}"
    structures, out = (args[1:3] + [f"{data}/structures", f"{data}/out"][len(args[1:3]) :])[:2]
    spark = SparkSession.builder.getOrCreate()
    store = run(spark, codes, structures, out, tuple(args[3:]) or FUNCTIONS, append=os.environ.get("EXCOUNT", "0") != "0")
    print(json.dumps({r["part"]: r["rows"] for r in store.describe().collect()}))


if __name__ == "__main__":
    main(sys.argv[1:])
