from graphloom.operators import validate
from graphloom.operators.store import EDGES, NODES
from graphloom.sources import overlays
from graphloom.streaming import append
from pyspark.sql import functions as F


def test_appended_stream_equals_build(spark, tmp_path):
    nodes, edges = overlays.toy(spark)
    names = ["part", *[c.split()[0] for c in NODES.split(", ")], "u", "v", "distance", "kinds"]
    for i, code in enumerate(["1BXL", "1G5J"]):
        n = nodes.filter(F.col("graph_code") == code).withColumn("part", F.lit("node"))
        e = edges.filter(F.col("graph_code") == code).withColumn("part", F.lit("edge"))
        n.unionByName(e, allowMissingColumns=True).select(names).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(append.ROW).json(str(tmp_path / "in"))
        append.append(stream, str(tmp_path / "store"), str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        store = append.current(spark, str(tmp_path / "store"))
        assert store.graphs.count() == i + 1
    assert all(df.isEmpty() for df in validate.diff((nodes, edges), store.raw()).values())
    again = append.insert_batch(str(tmp_path / "store"))
    again(spark.createDataFrame([], append.ROW), 0)  # a batch that was committed before
    assert append.current(spark, str(tmp_path / "store")).graphs.count() == 2
    assert EDGES.startswith("graph_code")
