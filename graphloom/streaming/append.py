"""Extension: a stream of ingest rows appended to a stored collection, one version a micro-batch.

A micro-batch writes its own rows only. Its number is part of the version's manifest, so a batch
that is run again adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from graphloom.operators import versions
from graphloom.operators.store import EDGES, NODES, GraphStore, Meta

#: A stream carries nodes and edges in one schema; ``part`` tells which.
ROW = f"part string, {NODES}, u string, v string, distance double, kinds array<string>"


def current(spark: SparkSession, path: str) -> GraphStore:
    """The last committed version, or an empty store."""
    return GraphStore.read(spark, path) if versions.manifest(spark, path) else GraphStore.empty(spark, Meta())


def insert_batch(path: str, name: str = "stream"):
    """A function for foreachBatch; streams that write to one collection need names of their own."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if versions.manifest(spark, path) is None:
            GraphStore.empty(spark, Meta()).write(path)
        nodes = batch.filter("part = 'node'").select(*[c.split()[0] for c in NODES.split(", ")])
        edges = batch.filter("part = 'edge'").select(*[c.split()[0] for c in EDGES.split(", ")])
        GraphStore.append(spark, path, nodes, edges, batch=(name, batch_id))

    return run


def append(stream: DataFrame, path: str, checkpoint: str, name: str = "stream") -> DataStreamWriter:
    return stream.writeStream.foreachBatch(insert_batch(path, name)).option("checkpointLocation", checkpoint)
