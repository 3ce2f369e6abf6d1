import re

import pytest
from pyspark.sql import functions as F

from graphloom.operators import encode, prep, stats, validate, versions
from graphloom.operators.store import EDGES, NODES, GraphStore, Meta, Stored
from graphloom.sources import overlays

META = Meta("atom")


@pytest.fixture(scope="module")
def toy(spark):
    return tuple(df.cache() for df in overlays.toy(spark))


@pytest.fixture(scope="module")
def toy_store(toy):
    return GraphStore.build(*toy, META).settled()


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def same(a, b):
    return all(df.isEmpty() for df in validate.diff(a, b).values())


def many(spark, n=7):
    nodes = [(f"G{i}", i, j, f"A:ALA:{(i * 3 + j) % 11}", [float(i), float(j), 0.0], float(j)) for i in range(n) for j in range(i % 4 + 1)]
    edges = [(f"G{i}", i, j, f"A:ALA:{(i * 3 + j) % 11}", f"A:ALA:{(i * 3 + j + 1) % 11}", float(j), ["b", "a"]) for i in range(n) for j in range(i % 4)]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


def test_toy_counts_and_ids(toy_store):
    assert rows(toy_store.graphs, "graph_id", "graph_code") == [(0, "1BXL"), (1, "1G5J")]
    labels = dict((b, a) for a, b in rows(toy_store.node_dict, "node_id", "node_label"))
    assert labels == {"A:ALA:89:N": 0, "A:ALA:89:CA": 1, "A:GLN:88:C": 2, "A:ALA:89:C": 3, "A:ALA:89:CB": 4, "A:GLU:48:C": 5}
    edges = rows(toy_store.edge_dict, "edge_id", "src_label", "dst_label")
    assert len(edges) == 5 and all(a <= b for _, a, b in edges)
    assert edges[0] == (0, "A:ALA:89:CA", "A:ALA:89:N")
    assert toy_store.graph_edges.count() == 8


def test_label_parts(toy_store):
    got = toy_store.node_dict.filter("node_id = 1").first()
    assert (got.chain_id, got.residue_name, got.residue_number, got.atom_type, got.element_symbol) == ("A", "ALA", 89, "CA", "C")


def test_round_trip(toy, toy_store):
    assert same(toy, toy_store.raw())


def test_extract_is_case_blind_and_unknown_is_empty(toy_store):
    assert toy_store.extract("1bxl")[0].count() == 5
    assert toy_store.extract("none")[0].isEmpty()
    assert toy_store.extract_many(["1bxl", "1G5J", "1g5j"])[0].count() == 10


def test_duplicate_insert(spark, toy, toy_store):
    nodes, edges = toy
    moved = nodes.withColumn("b_factor", F.col("b_factor") + 100)
    assert same(toy_store.insert(moved, edges).raw(), toy)
    assert same(toy_store.insert(moved, edges, "replace").raw(), (moved, edges))
    with pytest.raises(ValueError):
        toy_store.insert(moved, edges, "error")
    with pytest.raises(ValueError):
        toy_store.insert(moved, edges, meta=Meta("CA"))


def test_insert_in_steps_equals_build(spark):
    nodes, edges = many(spark)
    early = GraphStore.build(nodes.filter("seq < 3"), edges.filter("seq < 3"))
    grown = early.insert(nodes.filter("seq >= 3"), edges.filter("seq >= 3"))
    whole = GraphStore.build(nodes, edges)
    assert rows(grown.node_dict, "node_id", "node_label") == rows(whole.node_dict, "node_id", "node_label")
    assert rows(grown.graph_edges, "graph_id", "edge_id") == rows(whole.graph_edges, "graph_id", "edge_id")


def test_remove_makes_ids_dense(spark):
    nodes, edges = many(spark)
    left = GraphStore.build(nodes, edges).remove(["G0", "g3", "nothing"])
    assert [i for (i,) in rows(left.graphs, "graph_id")] == list(range(5))
    n = left.node_dict.count()
    assert [i for (i,) in rows(left.node_dict, "node_id")] == list(range(n))
    assert same(left.raw(), (nodes.filter("seq not in (0, 3)"), edges.filter("seq not in (0, 3)")))


def test_remove_all_leaves_an_empty_store(toy_store):
    empty = toy_store.remove(["1bxl", "1g5j"])
    assert empty.graphs.isEmpty() and empty.node_dict.isEmpty()


@pytest.mark.parametrize("codes", [None, ["g1", "G6"]])
def test_split_then_merge(spark, codes):
    nodes, edges = many(spark)
    store = GraphStore.build(nodes, edges).settled()
    a, b = store.split(codes)
    assert a.graphs.count() == (3 if codes is None else 2)
    assert same(GraphStore.merge([a, b]).raw(), store.raw())


def test_merge_last_store_wins(spark, toy, toy_store):
    nodes, edges = toy
    moved = nodes.withColumn("b_factor", F.col("b_factor") + 100)
    later = GraphStore.build(moved.filter("graph_code = '1BXL'"), edges.filter("graph_code = '1BXL'"), META)
    stores = [toy_store, later]
    got = {r.graph_code: r.b for r in GraphStore.merge(stores).extract_nodes().groupBy("graph_code").agg(F.max("b_factor").alias("b")).collect()}
    assert got["1BXL"] >= 100 > got["1G5J"] and len(stores) == 2
    with pytest.raises(ValueError):
        GraphStore.merge([toy_store, GraphStore.empty(spark)])


def test_write_and_read_one_graph(spark, toy, toy_store, tmp_path):
    path = str(tmp_path / "store")
    toy_store.write(path)
    back = GraphStore.read(spark, path)
    assert back.meta == META and same(back.raw(), toy)
    one = GraphStore.read_graph(spark, path, "1g5j").extract_nodes()
    assert one.count() == 5
    # memberships of a few graphs are told to the scan of the dictionary
    assert re.search(r"PartitionFilters: \[[^\]]*range#", one._jdf.queryExecution().executedPlan().toString())


def test_value_pools(toy_store):
    nodes = encode.node_value_pool(toy_store.graph_nodes)
    assert nodes.filter("attr = 'coords'").count() == 10 and nodes.filter("attr = 'b_factor'").count() == 8
    edges = encode.edge_value_pool(toy_store.graph_edges)
    assert edges.filter("attr = 'distance'").count() == 8 and edges.filter("attr = 'kind'").count() == 1


def test_statistics(toy_store):
    assert stats.totals(stats.graph_sizes(toy_store)).first().asDict() == {"n_graphs": 2, "n_nodes": 10, "n_edges": 8}
    assert stats.redundancy(toy_store).first().edge_redundancy == 1 - 5 / 8
    assert {r.part: r.rows for r in toy_store.describe().collect()}["edge_dict"] == 5


def test_empty_store(spark):
    store = GraphStore.empty(spark)
    assert store.codes().isEmpty() and stats.totals(stats.graph_sizes(store)).first().n_nodes == 0
    nodes, edges = many(spark)
    assert same(store.insert(nodes, edges).raw(), (nodes, edges))


def test_written_where_it_was_read(spark, tmp_path):
    """A store may be written to the place its rows come from, and readers keep their version."""
    nodes, edges = many(spark)
    path = str(tmp_path / "store")
    assert GraphStore.build(nodes.filter("seq < 3"), edges.filter("seq < 3")).write(path) == 1
    old = GraphStore.read(spark, path)
    assert old.insert(nodes.filter("seq >= 3"), edges.filter("seq >= 3")).write(path) == 2
    assert same(GraphStore.read(spark, path).raw(), (nodes, edges))
    assert same(old.raw(), (nodes.filter("seq < 3"), edges.filter("seq < 3")))
    assert same(GraphStore.read(spark, path, version=1).raw(), old.raw())
    with pytest.raises(FileNotFoundError):
        GraphStore.read(spark, path, version=3)
    with pytest.raises(RuntimeError):  # a writer that started from version 1
        versions.commit(spark, path, versions.manifest(spark, path, 1), 1)
    assert versions.vacuum(spark, path) == 1 and versions.vacuum(spark, path) == 0
    assert same(GraphStore.read(spark, path).raw(), (nodes, edges))


def test_append_writes_new_rows_only(spark, tmp_path):
    nodes, edges = many(spark)
    path = str(tmp_path / "store")
    GraphStore.build(nodes.filter("seq < 3"), edges.filter("seq < 3")).write(path)
    assert GraphStore.append(spark, path, nodes.filter("seq >= 2"), edges.filter("seq >= 2"), batch=("s", 0)) == 2
    assert GraphStore.append(spark, path, nodes, edges, batch=("s", 0)) == 2
    whole, grown = GraphStore.build(nodes, edges), GraphStore.read(spark, path)
    assert rows(grown.node_dict, "node_id", "node_label") == rows(whole.node_dict, "node_id", "node_label")
    assert rows(grown.graph_edges, "graph_id", "edge_id") == rows(whole.graph_edges, "graph_id", "edge_id")
    entry = versions.manifest(spark, path)
    added = spark.read.parquet(f"{path}/data/graph_nodes/{entry['tables']['graph_nodes']['folders'][1]}")
    assert len(entry["tables"]["graph_nodes"]["folders"]) == 2 and added.count() == nodes.filter("seq >= 3").count()
    with pytest.raises(ValueError):
        GraphStore.append(spark, path, nodes, edges, "error")
    assert same((GraphStore.read_graphs(spark, path, ["g2", "G6"]).raw()), (nodes.filter("seq in (2, 6)"), edges.filter("seq in (2, 6)")))


def test_annotations_stay(spark):
    nodes, edges = many(spark)
    size = lambda s: s.graph_nodes.groupBy("graph_id").agg(F.count("*").alias("size"))
    early = GraphStore.build(nodes.filter("seq < 3"), edges.filter("seq < 3")).annotate(size)
    want = {"G0": 1, "G1": 2, "G2": 3, "G3": None, "G4": None, "G5": None, "G6": None}
    late = nodes.filter("seq >= 3"), edges.filter("seq >= 3")
    sizes = lambda s: {r.graph_code: r.size for r in s.graphs.collect()}
    assert sizes(early.insert(*late)) == want
    assert sizes(GraphStore.merge([GraphStore.build(*late), early])) == want
    assert sizes(early.compact()) == {k: v for k, v in want.items() if v}


def test_graphs_without_nodes_and_edges_without_nodes(spark):
    nodes, edges = many(spark)
    codes = spark.createDataFrame([("g6", 6), ("none", 7)], "graph_code string, seq long")
    lone = spark.createDataFrame([("ALONE", 8, 0, "A:GLY:1", "A:GLY:2", 1.0, ["a"])], EDGES)
    store = GraphStore.build(nodes, edges.unionByName(lone), codes=codes)
    assert rows(store.graphs, "graph_id", "graph_code") == [(i, f"G{i}") for i in range(7)] + [(7, "NONE"), (8, "ALONE")]
    assert store.extract_edges("alone").count() == 1 and store.extract_nodes("none").isEmpty()
    assert store.graph_edges.select("edge_id").distinct().count() == store.edge_dict.count()
    sizes = {r.graph_code: (r.n_nodes, r.n_edges) for r in stats.graph_sizes(store).collect()}
    assert sizes["NONE"] == (0, 0) and sizes["ALONE"] == (0, 1)
    left = prep.complete(store.extract_nodes(), stats.graph_sizes(store))
    assert "NONE" not in {r.graph_code for r in left.collect()} and left.count() == 7
    later = store.insert(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES), codes=spark.createDataFrame([("more", 0)], "graph_code string, seq long"))
    assert rows(later.graphs, "graph_id", "graph_code")[-1] == (9, "MORE")


def test_merge_moves_ids_without_labels(spark):
    nodes, edges = many(spark)
    a, b = (GraphStore.build(nodes.filter(c), edges.filter(c)).settled() for c in ("seq < 5", "seq >= 3"))
    merged = GraphStore.merge([a, b])
    assert same(merged.raw(), (nodes, edges))
    assert merged.graph_nodes.select("node_id").distinct().count() == merged.node_dict.count()
    plan = merged.graph_nodes._jdf.queryExecution().executedPlan().toString()
    assert "node_label" not in plan
    # ids in the order of first use: the last store's graphs come first
    first = merged.graph_nodes.groupBy("node_id").agg(F.min("graph_id").alias("g")).orderBy("node_id").collect()
    assert [r.g for r in first] == sorted(r.g for r in first)


def test_one_graph_reads_few_files(spark, tmp_path):
    """Of 64 folders of dictionary entries a graph's own are read."""
    n = 300_000
    nodes = spark.range(n).selectExpr("concat('G', cast(id / 100 as int)) as graph_code", "cast(id / 100 as long) as seq", "id as pos", "concat('A:ALA:', id) as node_label", "array(1d, 2d, 3d) as coords", "1d as b_factor")
    path = str(tmp_path / "store")
    GraphStore.build(nodes, spark.createDataFrame([], EDGES)).write(path)
    stored = Stored.open(spark, path)
    few = stored.extract(["G1500", "g7", "none"])
    assert few[0].count() == 200 and few[1].isEmpty() and {r.graph_code for r in few[0].select("graph_code").distinct().collect()} == {"G1500", "G7"}
    assert sorted(map(str, few[0].collect())) == sorted(map(str, stored.store.extract_nodes(["g7", "g1500"]).select(few[0].columns).collect()))
    assert stored.extract(["none"])[0].isEmpty() and stored.extract([])[1].isEmpty()
    entries = stored.graphs(["g1500"])
    assert entries.extract_nodes().count() == 100 and entries.extract_edges().isEmpty()
    read = stored.files["node_dict"].select(F.input_file_name().alias("f")).distinct().count()
    used = entries.node_dict.select(F.input_file_name().alias("f")).distinct().count()
    assert read >= 64 and used <= 2
