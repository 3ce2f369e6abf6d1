"""What queries shuffle, broadcast and write as tables grow."""

import os

import numpy as np
import pytest
from graphloom.operators import bitmaps, construct, encode, layers, lineage, store
from graphloom.operators.store import EDGES, NODES, GraphStore
from graphloom.plans import catalog
from graphloom.plans.registry import QUERIES
from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().toString()


def points(spark, n, graphs, seed=5):
    rng = np.random.default_rng(seed)
    rows = [(g, g * n + i, rng.uniform(-9, 9, 3).round(1).tolist(), "A", "ALA", i, "C") for g in range(graphs) for i in range(n)]
    return rows, spark.createDataFrame(rows, "graph_id long, node_id long, coords array<double>, chain_id string, residue_name string, residue_number int, element_symbol string")


def brute(rows, reach):
    out = set()
    for g in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == g]
        at = np.array([r[2] for r in mine])
        d = at[:, None] - at[None]
        d = np.sqrt(d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2])
        out |= {(g, mine[i][1], mine[j][1]) for i, j in np.argwhere(d <= reach) if i < j}
    return out


@pytest.mark.parametrize("small", [512, 4])
def test_pairs_of_small_and_large_graphs(spark, monkeypatch, small):
    monkeypatch.setattr(construct, "SMALL", small)
    rows, nodes = points(spark, 60, 3)
    # on borders of cells, on both sides of zero
    rows += [(9, 900 + i, [x, 0.0, -x], "A", "ALA", i, "C") for i, x in enumerate((-6.0, -4.0, -2.0, 0.0, 2.0, 4.0, 6.0, 4.004, -4.004))]
    nodes = spark.createDataFrame(rows, nodes.schema)
    for reach in (2.0, 2.9, 4.0):
        got = [(r.graph_id, r.u, r.v) for r in construct.near_pairs(nodes, reach).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, reach)
    bonds = {(r.graph_id, r.u, r.v) for r in construct.peptide_bonds(nodes).collect()}
    assert bonds == {(a[0], a[1], b[1]) for a, b in zip(rows, rows[1:]) if a[0] == b[0]}


def test_pairs_broadcast_and_multiply_no_nodes(spark):
    """A side that looks small on disk went to the driver whole, and 27 times over."""
    _, nodes = points(spark, 20, 2)
    text = plan(construct.near_pairs(nodes, 3.0))
    assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text and "Generate" not in text
    assert "BroadcastHashJoin" not in plan(construct.by_rules(nodes))


def test_rules_of_one_search(spark):
    _, nodes = points(spark, 40, 2)
    kinds = ["ionic", "hydrophobic", "bb_carbonyl_carbonyl"]
    want = sorted(tuple(r) for k in kinds for r in construct.by_rule(nodes, k).collect())
    got = construct.by_rules(nodes, {k: construct.RULES[k] for k in kinds})
    assert plan(got).split("== Physical Plan ==")[1].count("SortMergeJoin") == 1
    assert sorted(tuple(r) for r in got.collect()) == want and want


def test_structures_whose_labels_repeat(spark, tmp_path):
    """Beyond 260,000 parts chains and numbers start anew; such atoms are of other structures and all stay."""
    keys = [1, 260_001, 260_002, 520_001, 100_001, 7_000_001]
    spark.createDataFrame([(k, 7) for k in keys], "p_partkey long, p_size int").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    got = catalog.read_structures(spark, str(tmp_path)).collect()
    chain = lambda k: chr(65 + k // 10_000 % 26)
    want = sorted((f"{chain(k)}:ALA:{k % 10_000}:{'CA' if k % 2 == 0 else 'N'}", 7.0, float(k % 100), -1.5, 20.25) for k in keys)
    assert sorted(tuple(r) for r in got) == want and len({w[0] for w in want}) < len(want)


DATA = "/root/testdata/sf0.001"
with_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are absent")
KEPT, OTHERS = {}, {}  # tables that these runs share, and no others
OF_NODES = ["bitmap_shared_by_all", "bitmap_union", "bitmap_structure", "bitmap_overlap", "extract_many", "edges_peptide", "edges_pi_stacking", "complete_graph_filter", "graph_annotations", "complete_edge_list", "split_halves_left"]


@with_tables
@pytest.mark.parametrize("name", OF_NODES)
def test_nodes_are_read_without_making_edges(spark, monkeypatch, name):
    def no(*_):
        raise AssertionError("edges were made")

    monkeypatch.setattr(catalog, "_KEPT", KEPT)
    monkeypatch.setattr(catalog.overlays, "order_edges", no)
    QUERIES[name](spark, DATA).write.format("noop").mode("overwrite").save()


def test_pairs_of_an_order_take_one_shuffle_of_nodes(spark):
    nodes = spark.createDataFrame([("O1", 1, 0, "A:ALA:1", [0.0, 0.0, 0.0], 1.0)], NODES)
    text = plan(catalog.overlays.order_edges(nodes)).split("== Physical Plan ==")[1]
    assert text.count("hashpartitioning") == 2  # the same one on both sides of the join, none for places


def physical(df):
    return plan(df).split("== Physical Plan ==")[1]


def test_memberships_are_shuffled_to_labels_and_to_graphs_alone(spark):
    """rows that had met their graph were shuffled again, and small dictionaries were broadcast."""
    rows = [(f"O{g}", g, p, f"A:ALA:{g % 3 + p}", [0.0, 0.0, 0.0], float(p)) for g in range(6) for p in range(3)]
    nodes = spark.createDataFrame([*rows, ("O1", 1, 9, "A:ALA:1", [1.0, 0.0, 0.0], 9.0)], NODES)
    graphs, dictionary = encode.graph_catalog(nodes), encode.node_dictionary(nodes)
    got = encode.graph_nodes(nodes, graphs, dictionary)
    text = physical(got)
    # both sides of two joins; the broadcasts are those of the ranges inside dense ids
    assert text.count("SortMergeJoin") == 2 and "node_label" not in "".join(x for x in text.splitlines() if "BroadcastHashJoin" in x)
    assert "hashpartitioning(graph_id" not in text
    assert got.count() == 18 and {r.b_factor for r in got.filter("graph_id = 1").collect()} == {9.0, 1.0, 2.0}


def test_bitmaps_are_shuffled_as_memberships_and_once(spark):
    """bitmaps were made by graph and word, and dealt out again by folder or by graph."""
    members = spark.createDataFrame([(g, i) for g in range(200) for i in range(g % 7, 500, 90)], "graph_id long, node_id long")
    s = GraphStore(members, members, members, members, members)
    top = {"graph_id": 1 << 23, "node_id": 500}
    bits = s._bits("graph_nodes", "node_id", F.pmod("graph_id", F.lit(4)).cast("int"), 4, top)
    assert physical(bits).count("Exchange") == 1
    want = sorted(tuple(r) for r in bitmaps.words(members, "node_id").collect())
    assert sorted(tuple(r) for r in bits.select("graph_id", "word", "bits").collect()) == want
    assert {(r.graph_id % 4) for r in bits.filter("bucket = 3").collect()} == {3}


def test_union_of_memberships_makes_no_bitmaps_of_graphs(spark):
    """the union of bitmaps that were made and written for it."""
    members = spark.createDataFrame([(g, i) for g in range(60) for i in range(g % 7, 500, 90)], "graph_id long, node_id long")
    groups = spark.createDataFrame([(g, g % 5) for g in range(50)] + [(1, 9)], "graph_id long, group long")
    want = sorted(tuple(r) for r in bitmaps.union(bitmaps.words(members, "node_id"), groups).collect())
    got = bitmaps.union_of(members, "node_id", groups)
    assert sorted(tuple(r) for r in got.collect()) == want and want


@with_tables
@pytest.mark.parametrize("name", ["bitmap_union", "bitmap_shared_by_all", "complete_graph_filter", "empty_graphs_dropped"])
def test_nodes_are_read_without_writing_a_collection(spark, monkeypatch, name):
    """what needs memberships alone wrote a whole collection, or decoded all labels."""

    def no(*_, **__):
        raise AssertionError("written, or decoded")

    monkeypatch.setattr(catalog, "_KEPT", OTHERS)
    monkeypatch.setattr(catalog, "_write", no)
    monkeypatch.setattr(GraphStore, "extract_nodes", no)
    QUERIES[name](spark, DATA).write.format("noop").mode("overwrite").save()


@with_tables
def test_points_are_not_joined_by_broadcast(spark, monkeypatch):
    """A dictionary that looks small on disk went to the driver."""
    plans = []
    keep = catalog.settled
    monkeypatch.setattr(catalog, "_KEPT", {})
    monkeypatch.setattr(catalog, "settled", lambda df, name: (plans.append((name, physical(df))), keep(df, name))[1])
    catalog.order_points(spark, DATA)
    made = dict(plans)["points"]
    assert "SortMergeJoin" in made and "Broadcast" not in made


@with_tables
def test_points_are_made_without_a_store_of_nodes(spark, monkeypatch):
    """Memberships were encoded and written, then met the dictionary by id in one more shuffle."""
    plans = []
    want = catalog.nodes_kept(spark, DATA)
    want = want.graph_nodes.join(want.node_dict, "node_id").select("graph_id", "node_id", "coords", "chain_id", "residue_name", "residue_number", "element_symbol")

    def no(*_, **__):
        raise AssertionError("memberships were encoded")

    keep = catalog.settled
    monkeypatch.setattr(catalog, "_KEPT", {})
    monkeypatch.setattr(catalog, "settled", lambda df, name: (plans.append((name, physical(df))), keep(df, name))[1])
    monkeypatch.setattr(encode, "graph_nodes", no)
    got = catalog.order_points(spark, DATA)
    made = dict(plans)["points"]
    # nodes and dictionary by label, nodes and catalogue by seq
    assert made.count("hashpartitioning(node_label") == 2 and made.count("hashpartitioning(seq") == 2 and made.count("hashpartitioning") == 4
    assert got.schema == want.schema and got.count() > 5000
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


@with_tables
def test_points_of_a_graph_lie_together(spark, monkeypatch):
    """Points lay by node id, so that counting those of a graph shuffled nearly a row for each."""
    monkeypatch.setattr(catalog, "_KEPT", {})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or small tables are one file
    try:
        at = catalog.order_points(spark, DATA).select("graph_id", F.input_file_name().alias("file"))
        assert at.select("file").distinct().count() > 1
        assert at.groupBy("graph_id").agg(F.count_distinct("file").alias("n")).filter("n > 1").isEmpty()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def entries_of(store):
    return {t: sorted(map(repr, df.collect())) for t, df in store.tables.items()}


def some_rows(spark, graphs=9):
    nodes = [(f"O{g}", g, p, f"A:ALA:{(g * 3 + p) % 11}", [float(g), float(p), 0.0], float(p)) for g in range(graphs) for p in range(g % 4 + 1)]
    edges = [(f"O{g}", g, p, f"A:ALA:{(g * 3 + p) % 11}", f"A:ALA:{(g * 3 + p + 1) % 11}", float(p), ["b", "a"]) for g in range(graphs) for p in range(g % 4)]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


def planned(monkeypatch, *modules):
    """Plans of all tables that are settled from now on."""
    plans = []

    def told(df, name, *more):
        plans.extend((name, physical(x)) for x in (df if isinstance(df, list) else [df]))
        return lineage.settled(df, name, *more)

    for m in modules:
        monkeypatch.setattr(m, "settled", told)
    return plans


def broadcasts(text):
    """Broadcast joins but those of the ranges inside dense ids, of a row a range."""
    return [x for x in text.splitlines() if "BroadcastHashJoin" in x and "_range" not in x]


def test_insert_broadcasts_no_table_of_the_store(spark, monkeypatch):
    """known codes and labels, and tenths of graphs, went to the driver whole."""
    nodes, edges = some_rows(spark)
    early = GraphStore.build(nodes.filter("seq < 6"), edges.filter("seq < 6")).settled()
    plans = planned(monkeypatch, store)
    grown = early.insert(nodes.filter("seq >= 4"), edges.filter("seq >= 4"))
    grown = grown.settled()
    plans.append(("decoded", physical(grown.extract_nodes())))
    assert "added" in dict(plans) and [b for _, text in plans for b in broadcasts(text)] == []
    whole = GraphStore.build(nodes, edges).settled()
    assert entries_of(grown) | {"graphs": 0} == entries_of(whole) | {"graphs": 0}  # whose seq goes on from the store's


@with_tables
def test_tenths_are_not_broadcast(spark, monkeypatch):
    """a table of all codes that is small on disk."""
    monkeypatch.setattr(catalog, "_KEPT", OTHERS)
    plans = planned(monkeypatch, catalog)
    catalog.ranked(spark, DATA)
    made = dict(plans)
    assert all("SortMergeJoin" in made[t] and broadcasts(made[t]) == [] for t in ("nodes-by-part", "edges-by-part"))


def test_removal_broadcasts_no_ids(spark, monkeypatch):
    """tables of old and new ids went to the driver whole."""
    nodes, edges = some_rows(spark)
    whole = GraphStore.build(nodes, edges).settled()
    left = whole.remove(["O0", "O5"])
    for df in (left.graph_nodes, left.graph_edges, left.extract_nodes(), left.extract_edges()):
        assert broadcasts(physical(df)) == []
    want = GraphStore.build(nodes.filter("seq not in (0, 5)"), edges.filter("seq not in (0, 5)"))
    told = lambda s: sorted((r.graph_code, r.src_label, r.dst_label, r.distance) for r in s.extract_edges().collect())
    assert told(left) == told(want) and told(left)


@with_tables
def test_surviving_edges_are_decoded_without_broadcasts(spark, monkeypatch):
    """the catalogue and the dictionary of edges went to the driver whole."""
    monkeypatch.setattr(catalog, "_KEPT", OTHERS)
    assert broadcasts(physical(catalog.remove_graphs_edges(spark, DATA))) == []


def made_in_slices(spark, monkeypatch, rows):
    """A store of the rows whose joins were made in slices of 7 rows, and the names of tables that were."""
    cut = []
    keep = lineage.settled
    monkeypatch.setattr(lineage, "SLICE", 7)
    monkeypatch.setattr(lineage, "settled", lambda df, name, *more: (cut.append(name) if isinstance(df, list) else None, keep(df, name, *more))[1])
    return GraphStore.built(*rows), cut


def test_a_store_made_in_slices_is_the_same_and_leaves_no_scratch(spark, monkeypatch):
    """All edges were shuffled at a time, and tables made on the way stayed."""
    rows = some_rows(spark)
    want = entries_of(GraphStore.build(*rows).settled())
    folder = lineage.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    got, cut = made_in_slices(spark, monkeypatch, rows)
    left = {n for n in set(os.listdir(folder)) - before if n.startswith("graphloom-")}
    assert len(left) == 5 and {"firsts", "edge-ids", "graph_edges"} <= set(cut) and entries_of(got) == want
    edges = sorted((r.graph_code, r.edge_id, r.src_label, r.distance) for r in got.extract_edges().collect())
    assert {"named", "decoded"} <= set(cut) and len(edges) == len(want["graph_edges"])
    assert spark.conf.get(lineage._CLEANUP, None) in (None, "false")


def test_a_collection_is_written_small(spark, tmp_path):
    """folders took the session's compression, twice the store's size and more."""
    GraphStore.build(*some_rows(spark)).write(str(tmp_path / "store"))
    files = [f for _, _, names in os.walk(tmp_path) for f in names if f.endswith(".parquet")]
    assert files and all(".zstd." in f for f in files)


def test_kinds_are_mapped_by_set(spark):
    """memberships were taken apart by kind and put together again in shuffles of their own."""
    members = GraphStore.build(*some_rows(spark)).settled().graph_edges
    got = encode.edge_mapping(members, encode.edge_value_pool(members))
    assert "hashpartitioning(graph_id" not in physical(got)
    assert {tuple(r.kind_values) for r in got.collect()} == {(0, 1)} and got.count() == members.count()


def test_raw_rows_meet_their_graph_once(spark):
    """decoded edges were shuffled again to meet seq."""
    nodes, edges = GraphStore.build(*some_rows(spark)).settled().raw()
    assert "hashpartitioning(graph_code" not in physical(edges) + physical(nodes)


def test_products_travel_along_edges_instead_of_vectors(spark, monkeypatch):
    """each edge carried the whole vectors of its ends."""
    nodes = spark.createDataFrame([(0, i, [float(i + j) for j in range(6)], [float(i), 0.0, 1.0]) for i in range(3)], "graph_id long, node_id long, h array<double>, coords array<double>")
    edges = spark.createDataFrame([(0, 0, 1), (0, 1, 2)], "graph_id long, u long, v long")
    sent, send = [], layers._sent
    monkeypatch.setattr(layers, "_sent", lambda *a, **k: (sent.append(send(*a, **k)), sent[-1])[1])
    ones = lambda *shape: np.full(shape, 0.1)
    layers.sage(nodes, edges, ones(2, 6), ones(2, 6), np.zeros(2)).collect()
    layers.equivariant(nodes, edges, [(ones(2, 13), None, "silu")], [(ones(1, 2), None, "none")], [(ones(6, 8), None, "none")]).collect()
    assert len(sent) == 2 and all({r.size for r in df.select(F.size("_h").alias("size")).collect()} == {2} for df in sent)
