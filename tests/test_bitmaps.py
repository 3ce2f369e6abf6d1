import random

import pytest

from graphloom.operators import bitmaps
from graphloom.operators.store import EDGES, NODES, GraphStore, Stored


def members(seed=1, graphs=12, ids=400):
    rng = random.Random(seed)
    return {g: set(rng.sample(range(ids), rng.randrange(1, 40))) | {5, 64, 127, 128} for g in range(graphs)}


@pytest.fixture(scope="module")
def made(spark):
    sets = members()
    rows = [(g, i) for g, s in sets.items() for i in s for _ in range(1 + i % 2)]  # repeated memberships too
    return sets, bitmaps.words(spark.createDataFrame(rows, "graph_id long, node_id long"), "node_id").cache()


def back(df, key):
    out = {}
    for r in bitmaps.ids(df, "node_id").collect():
        out.setdefault(r[key], set()).add(r["node_id"])
    return out


def test_words_and_back(made):
    sets, words = made
    assert back(words, "graph_id") == sets
    assert {r.graph_id: r.n for r in bitmaps.counts(words, "graph_id").collect()} == {g: len(s) for g, s in sets.items()}
    assert words.count() == sum(len({i // 64 for i in s}) for s in sets.values())


def test_algebra(spark, made):
    sets, words = made
    groups = spark.createDataFrame([(g, g % 3) for g in sets] + [(0, 9)], "graph_id long, group long")
    of = {k: [sets[g] for g in sets if g % 3 == k] for k in range(3)} | {9: [sets[0]]}
    assert back(bitmaps.union(words, groups), "group") == {k: set.union(*v) for k, v in of.items()}
    assert back(bitmaps.shared_by_all(words, groups), "group") == {k: set.intersection(*v) for k, v in of.items()}
    got = {r.graph_id: r.n for r in bitmaps.overlap(words, words.filter("graph_id in (1, 2)")).collect()}
    assert got == {g: len(s & (sets[1] | sets[2])) for g, s in sets.items()}


def test_stored_bitmaps(spark, tmp_path):
    nodes = [(f"G{i}", i, j, f"A:ALA:{(i * 3 + j) % 11}", [0.0] * 3, 0.0) for i in range(6) for j in range(i + 1)]
    edges = [(f"G{i}", i, j, f"A:ALA:{(i * 3 + j) % 11}", f"A:ALA:{(i * 3 + j + 1) % 11}", 1.0, ["a"]) for i in range(6) for j in range(i)]
    path = str(tmp_path / "store")
    half = [r for r in nodes if r[1] < 3], [r for r in edges if r[1] < 3]
    GraphStore.build(spark.createDataFrame(half[0], NODES), spark.createDataFrame(half[1], EDGES)).write(path)
    GraphStore.append(spark, path, spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES))
    stored = Stored.open(spark, path)
    assert {(r.graph_code, r.node_label) for r in stored.structure(["g2", "G4", "none"]).collect()} == {(r[0], r[3]) for r in nodes if r[1] in (2, 4)}
    assert stored.structure(["G5"], "edge_bits").count() == 5 and stored.structure(["G0"], "edge_bits").isEmpty()
    assert {(r.graph_id, r.node_id) for r in bitmaps.ids(stored.bits("node_bits"), "node_id").collect()} == {(r.graph_id, r.node_id) for r in stored.store.graph_nodes.collect()}


def test_no_rows(spark):
    empty = bitmaps.words(spark.createDataFrame([], "graph_id long, node_id long"), "node_id")
    groups = spark.createDataFrame([(1, 1)], "graph_id long, group long")
    assert bitmaps.ids(empty, "node_id").isEmpty() and bitmaps.union(empty, groups).isEmpty() and bitmaps.shared_by_all(empty, groups).isEmpty()
