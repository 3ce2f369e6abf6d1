import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions.residues import DESCRIPTORS, ONE_HOT_ORDER, one_hot
from graphloom.operators import construct, delaunay, knn
from graphloom.operators.delaunay import edges_of


def cloud(spark, n=40, seed=3):
    rng = np.random.default_rng(seed)
    names = [r for r in DESCRIPTORS if r != "UNK"]
    rows = [(g, i, rng.uniform(-8, 8, 3).tolist(), "AB"[i % 2], names[int(rng.integers(20))], i // 2, "CNOS"[i % 4]) for g in range(2) for i in range(n)]
    return rows, spark.createDataFrame(rows, "graph_id long, node_id long, coords array<double>, chain_id string, residue_name string, residue_number int, element_symbol string")


def pairs(rows, keep):
    out = set()
    for a, b in itertools.combinations(rows, 2):
        d = float(np.sqrt(((np.array(a[2]) - np.array(b[2])) ** 2).sum()))
        if a[0] == b[0] and keep(a, b, d):
            out.add((a[0], min(a[1], b[1]), max(a[1], b[1])))
    return out


def found(df):
    got = [(r.graph_id, r.u, r.v) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_threshold_window_and_rules(spark):
    rows, nodes = cloud(spark)
    assert found(construct.distance_threshold(nodes, 5)) == pairs(rows, lambda a, b, d: d <= 5)
    assert found(construct.distance_threshold(nodes, 5, 3)) == pairs(rows, lambda a, b, d: d <= 5 and (a[3] != b[3] or abs(a[5] - b[5]) >= 3))
    assert found(construct.distance_window(nodes, 3, 7)) == pairs(rows, lambda a, b, d: 3 <= d <= 7)
    ionic = construct.RULES["ionic"]
    either = lambda a, b: (a[4] in ionic.one and b[4] in ionic.other) or (b[4] in ionic.one and a[4] in ionic.other)
    assert found(construct.registry["ionic"](nodes)) == pairs(rows, lambda a, b, d: d <= ionic.high and either(a, b))
    gap = lambda a, b, d: d - (construct.RADII[a[6]] + construct.RADII[b[6]])
    assert found(construct.vdw(nodes)) == pairs(rows, lambda a, b, d: 0 < gap(a, b, d) <= 0.5)
    assert found(construct.vdw_clashes(nodes)) == pairs(rows, lambda a, b, d: gap(a, b, d) <= 0)
    assert found(construct.peptide_bonds(nodes)) == pairs(rows, lambda a, b, d: a[3] == b[3] and abs(a[5] - b[5]) == 1)


def test_knn(spark):
    rows, nodes = cloud(spark)
    want = set()
    for a in rows:
        near = sorted((float(np.linalg.norm(np.subtract(a[2], b[2]))), b[1]) for b in rows if a[0] == b[0] and a[1] != b[1])[:3]
        want |= {(a[0], min(a[1], i), max(a[1], i)) for _, i in near}
    assert found(construct.knn(nodes, 3)) == want


def test_combine(spark):
    _, nodes = cloud(spark, 12)
    got = construct.combine(nodes, [construct.fully_connected, lambda n: construct.distance_threshold(n, 5)])
    assert got.count() == 2 * 66
    assert all(("distance_threshold" in r.kinds) == (r.distance <= 5) for r in got.collect())


def test_delaunay_spheres_are_empty(spark):
    p = np.random.default_rng(1).random((25, 3))
    edges = set(edges_of(p))
    want = set()
    for four in itertools.combinations(range(len(p)), 4):
        a = p[four[0]]
        m = p[list(four[1:])] - a
        centre = np.linalg.solve(m, 0.5 * (m**2).sum(1))
        inside = ((p - a - centre) ** 2).sum(1) < (centre**2).sum() * (1 - 1e-9)
        if not inside.any():
            want |= set(itertools.combinations(four, 2))
    assert edges == want
    assert edges_of(np.zeros((5, 3))) == [] and len(edges_of(p[:3])) == 3
    nodes = spark.createDataFrame([(0, i, x.tolist()) for i, x in enumerate(p)], "graph_id long, node_id long, coords array<double>")
    assert found(construct.delaunay(nodes)) == {(0, a, b) for a, b in want}


def test_one_hot(spark):
    got = {r.n: r.h for r in spark.createDataFrame([(n,) for n in [*ONE_HOT_ORDER, "UNK", "XYZ"]], "n string").select("n", one_hot(F.col("n")).alias("h")).collect()}
    assert [got[n].index(1) for n in ONE_HOT_ORDER] == list(range(20))
    assert sum(got["UNK"]) == 0 and got["XYZ"] is None and ONE_HOT_ORDER[:2] == ["ALA", "CYS"]


PLACES = "graph_id long, node_id long, coords array<double>"


def near_by_hand(rows, k):
    """Edges (graph, u, v) to the k nearest placed nodes, ties to the smaller id."""
    out = set()
    ok = [r for r in rows if r[2] is not None and len(r[2]) == 3 and all(x is not None and np.isfinite(x) for x in r[2])]
    for g, i, at in ok:
        others = sorted((float(np.sqrt(((np.array(at) - np.array(b)) ** 2).sum())), j) for h, j, b in ok if h == g and j != i)
        out |= {(g, min(i, j), max(i, j)) for _, j in others[:k]}
    return out


@pytest.mark.parametrize("crowd", [4096, 5])
def test_knn_by_growing_cells(spark, crowd, monkeypatch):
    """Clusters with far outliers, a flat graph, a line of equal steps (ties), nodes in one place, graphs under k nodes, nodes without a place."""
    monkeypatch.setattr(knn, "CELL", crowd)
    rng = np.random.default_rng(4)
    rows = [(0, i, (rng.normal(0, 0.01, 3) + [i % 3, 0, 0]).tolist()) for i in range(60)] + [(0, 60, [500.0, 0.0, 0.0]), (0, 61, [0.0, -90.0, 1.0])]
    rows += [(1, i, [*rng.uniform(0, 9, 2).tolist(), 0.0]) for i in range(40)]
    rows += [(2, i, [float(i), 0.0, 0.0]) for i in range(20)]
    rows += [(3, i, [7.0, 7.0, 7.0]) for i in range(9)]
    rows += [(4, 0, [1.0, 2.0, 3.0]), (4, 1, [1.0, 2.0, 9.0]), (5, 0, [0.0, 0.0, 0.0])]
    rows += [(0, 70, None), (0, 71, [None, 1.0, 2.0]), (1, 72, [float("nan"), 0.0, 0.0]), (1, 73, [1.0, 2.0])]
    assert found(construct.knn(spark.createDataFrame(rows, PLACES), 3)) == near_by_hand(rows, 3)
    plan = construct.knn(spark.createDataFrame(rows[:20], PLACES), 3)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_nodes_without_a_place_have_no_edges(spark):
    rows = [(0, 0, [0.0, 0.0, 0.0]), (0, 1, [1.0, 0.0, 0.0]), (0, 2, None), (0, 3, [0.5, None, 0.0])]
    nodes = spark.createDataFrame(rows, PLACES)
    for f in (construct.knn, construct.fully_connected, construct.delaunay):
        assert found(f(nodes)) == {(0, 0, 1)}, f.__name__


@pytest.mark.parametrize("shape", ["cube", "clusters"])
def test_delaunay_over_many_leaves(spark, shape, monkeypatch):
    """Leaves of 40 nodes agree with one triangulation of the whole; a second graph is small."""
    monkeypatch.setattr(delaunay, "CAP", 40)
    rng = np.random.default_rng(6)
    p = rng.random((220, 3)) if shape == "cube" else np.concatenate([rng.normal(0, 1, (120, 3)), rng.normal(0, 0.02, (100, 3)) + [3, 1, 0]])
    small = rng.random((12, 3))
    rows = [(0, i, x.tolist()) for i, x in enumerate(p)] + [(1, i, x.tolist()) for i, x in enumerate(small)] + [(0, 900, p[0].tolist()), (2, 1, [0.0] * 3)]
    edges = construct.delaunay(spark.createDataFrame(rows, PLACES))
    want = {(g, a, b) for g, q in ((0, p), (1, small)) for a, b in delaunay.edges_of(q)}
    assert found(edges) == want


def test_spheres_inside_a_block():
    centre, radius = np.array([[0.5, 0.5, 0.5], [0.5, 0.5, 0.5], [0.5, 0.5, -3.0]]), np.array([0.01, 0.2, 9.2])
    block = np.array([0.25, 0.25, -1e-6]), np.array([0.75, 0.75, 0.75])
    inside = delaunay._contained(centre, radius, *block, np.ones(3))
    assert inside.tolist() == [True, False, False]
    # the last one reaches the graph's box in a cap of radius 0.45, which a wider block holds
    assert delaunay._contained(centre, radius, np.array([0.0, 0.0, -1e-6]), np.array([1.0, 1.0, 0.75]), np.ones(3)).tolist() == [True, False, True]
