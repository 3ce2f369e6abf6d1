"""3-D Delaunay triangulation of graphs of any size.

Space is halved along each axis until a leaf has at most ``CAP`` nodes. A leaf triangulates its own
nodes with those nearby, and then asks the rest of the graph whether a node lies in the circumsphere
of one of its simplices: first the 27 cells around it, then cells twice as wide, as long as a sphere
reaches farther. The deepest nodes in a sphere join the leaf, which is triangulated again. A leaf is
done once all circumspheres of its own nodes' simplices are inside the space it has asked and no
node lies in them: then its nodes have the simplices of the whole graph. Cells with many nodes
answer in parts, so no task holds a graph.

All leaves see the same coordinates, moved by 1e-8 of the graph's extent by a hash of the node, so
that cospherical nodes are triangulated one way everywhere; the hull is what four far points at
1000 times the extent see. Distances are those of the nodes as given.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .knn import AXES, boxes
from .lineage import settled
from .skew import by_group

CAP, DEPTH, MARGIN, SALT, FAR = 200, 20, 0.35, 5000, 1e3
CELL = ["cx", "cy", "cz"]
LEAF = ["graph_id", "depth", *CELL]
Q = ["qx", "qy", "qz"]


def _spheres(p: np.ndarray, tets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centre and squared radius of each tetrahedron's circumsphere; a flat one gets an infinite radius."""
    a = p[tets[:, 0]]
    rows = p[tets[:, 1:]] - a[:, None, :]
    right = 0.5 * (rows**2).sum(2)
    det = np.linalg.det(rows)
    flat = np.abs(det) < 1e-14 * np.maximum(1e-300, np.abs(rows).max((1, 2)) ** 3)
    rows[flat] = np.eye(3)
    centre = np.linalg.solve(rows, right[..., None])[..., 0]
    radius = (centre**2).sum(1)
    radius[flat] = np.inf
    return centre + a, radius


def tetrahedra(points: np.ndarray, corners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Simplices of distinct points and four corners around them (numbered last), with centres and squared radii; by insertion."""
    n = len(points)
    p = np.concatenate([points, corners])
    tets = np.array([[n, n + 1, n + 2, n + 3]])
    centre, radius = _spheres(p, tets)
    for i in range(n):
        inside = ((p[i] - centre) ** 2).sum(1) < radius * (1 + 1e-12)
        bad = tets[inside]
        faces = np.sort(np.concatenate([bad[:, [0, 1, 2]], bad[:, [0, 1, 3]], bad[:, [0, 2, 3]], bad[:, [1, 2, 3]]]), axis=1)
        rim, times = np.unique(faces, axis=0, return_counts=True)
        rim = rim[times == 1]
        fresh = np.column_stack([rim, np.full(len(rim), i)])
        new_centre, new_radius = _spheres(p, fresh)
        tets = np.concatenate([tets[~inside], fresh])
        centre, radius = np.concatenate([centre[~inside], new_centre]), np.concatenate([radius[~inside], new_radius])
    return tets, centre, radius


def _corners(middle: np.ndarray, span: float) -> np.ndarray:
    return np.array([[-1, -1, -1], [1, 1, -1], [1, -1, 1], [-1, 1, 1]], float) * FAR * span + middle


def _edges(tets: np.ndarray, n: int) -> np.ndarray:
    """Sorted pairs (i < j) of the simplices whose vertices are all below n."""
    real = tets[(tets < n).all(1)]
    if not len(real):
        return np.zeros((0, 2), int)
    return np.unique(np.sort(np.concatenate([real[:, [a, b]] for a in range(4) for b in range(a + 1, 4)]), axis=1), axis=0)


def edges_of(points: np.ndarray) -> list[tuple[int, int]]:
    """Sorted edges (i < j) between points; repeated points stand for the first of them.

    Fewer than five points are joined all with all. Cospherical points are triangulated one of the
    possible ways.
    """
    _, keep = np.unique(points, axis=0, return_index=True)
    keep = np.sort(keep)
    if len(keep) <= 4:
        return [(int(a), int(b)) for i, a in enumerate(keep) for b in keep[i + 1 :]]
    p = points[keep]
    tets, _, _ = tetrahedra(p, _corners(p.mean(0), max(float(np.ptp(p, axis=0).max()), 1e-9)))
    return [(int(keep[a]), int(keep[b])) for a, b in _edges(tets, len(p))]


# leaves -----------------------------------------------------------------------------------------


def _placed(nodes: DataFrame) -> DataFrame:
    """graph_id, node_id, x, y, z, the place q in a unit box (moved a little), its fine cell i, n and the extent of the graph."""
    at = [F.get("coords", F.lit(i)).alias(c) for i, c in enumerate(AXES)]
    once = settled(nodes.select("graph_id", "node_id", *at).groupBy("graph_id", *AXES).agg(F.min("node_id").alias("node_id")), "points")
    boxed = settled(boxes(once), "boxes")
    points = by_group(once, boxed, ["graph_id"], "n")
    longest = F.greatest(*[F.col(f"span_{c}") for c in AXES], F.lit(1e-300))
    points = points.withColumn("longest", longest)
    for q, c in zip(Q, AXES):
        span = F.col(f"span_{c}") / F.col("longest")
        moved = (F.pmod(F.xxhash64("node_id", F.lit(c)), F.lit(1 << 20)) / (1 << 20) - 0.5) * 1e-8 * span
        points = points.withColumn(f"e{c}", span).withColumn(q, (F.col(c) - F.col(f"low_{c}")) / F.col("longest") + moved)
        points = points.withColumn(f"i{c}", F.least(F.greatest(F.floor(F.col(q) * (1 << DEPTH)), F.lit(0)), F.lit((1 << DEPTH) - 1)))
    return settled(points.select("graph_id", "node_id", *AXES, *Q, *[f"i{c}" for c in AXES], "n", *[f"e{c}" for c in AXES]), "placed")


def _cell(depth: int) -> list:
    return [F.shiftright(f"i{c}", DEPTH - depth).alias(name) for name, c in zip(CELL, AXES)]


def _counts(points: DataFrame) -> tuple[DataFrame, int]:
    """(graph_id, depth, cell, n) of all depths down to the one where no cell has more than CAP nodes, and that depth."""
    out = []
    for depth in range(DEPTH + 1):
        out.append(settled(points.groupBy("graph_id", F.lit(depth).alias("depth"), *_cell(depth)).agg(F.count("*").alias("n")), "counts"))
        if out[-1].filter(F.col("n") > CAP).isEmpty():
            break
    return reduce(DataFrame.unionByName, out), len(out) - 1


def _leaves(counts: DataFrame, deepest: int) -> DataFrame:
    """Cells of at most CAP nodes whose parent has more."""
    full = counts.filter(F.col("n") > CAP).select("graph_id", (F.col("depth") + 1).alias("depth"), *[F.col(c).alias(f"p{c}") for c in CELL])
    small = counts.filter((F.col("n") <= CAP) | (F.col("depth") == deepest)).drop("n").withColumns({f"p{c}": F.shiftright(c, 1) for c in CELL})
    below = small.join(full, ["graph_id", "depth", *[f"p{c}" for c in CELL]], "left_semi")
    return settled(small.filter("depth = 0").unionByName(below).select(LEAF), "leaves")


CARRIED = ["n", "ex", "ey", "ez"]


def _members(points: DataFrame, leaves: DataFrame, depths: list[int]) -> DataFrame:
    """Each leaf's own nodes (core), and those within MARGIN of its width."""
    every = []
    for depth in depths:
        some = points
        for c, q, i in zip(CELL, Q, AXES):
            own = F.shiftright(f"i{i}", DEPTH - depth)
            reach = [F.least(F.greatest(F.floor(F.col(q) * (1 << depth) + s * MARGIN), F.lit(0)), F.lit((1 << depth) - 1)) for s in (-1, 1)]
            some = some.withColumn(f"o{c}", own).withColumn(c, F.explode(F.sequence(F.least(reach[0], own), F.greatest(reach[1], own))))
        core = F.lit(True)
        for c in CELL:
            core = core & (F.col(c) == F.col(f"o{c}"))
        every.append(some.select("graph_id", F.lit(depth).alias("depth"), *CELL, core.alias("core"), "node_id", *AXES, *Q, *CARRIED))
    return reduce(DataFrame.unionByName, every).join(leaves, LEAF, "left_semi")


# a leaf's turn ----------------------------------------------------------------------------------


def _block(cell: np.ndarray, depth: int, around: int, extent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of a cell, with its neighbours if asked; what is beyond the graph's box belongs to the outermost cells."""
    low, high = np.maximum(cell - around, 0), np.minimum(cell + around, (1 << depth) - 1) + 1
    lows, highs = low / (1 << depth), high / (1 << depth)
    return np.where(low == 0, -1e-6, lows), np.where((high == 1 << depth) | (highs >= extent), extent + 1e-6, highs)


def _reaches(centre: np.ndarray, radius: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    gap = np.maximum(np.maximum(low - centre, centre - high), 0)
    return (gap**2).sum(1) < radius


def _contained(centre: np.ndarray, radius: np.ndarray, low: np.ndarray, high: np.ndarray, extent: np.ndarray) -> np.ndarray:
    """Spheres that don't reach the graph's box outside the block low to high."""
    box, inside = (np.full(3, -1e-6), extent + 1e-6), np.ones(len(centre), bool)
    for axis in range(3):
        for side, end in ((0, low[axis]), (1, high[axis])):
            if (side == 0 and end <= box[0][axis]) or (side == 1 and end >= box[1][axis]):
                continue
            lows, highs = box[0].copy(), box[1].copy()
            (highs if side == 0 else lows)[axis] = end
            inside &= ~_reaches(centre, radius, lows, highs)
    return inside


def _turn(leaf: dict, level: int, members: dict[str, np.ndarray]) -> tuple[dict, list[tuple]]:
    """The leaf's edges, whether it has all it needs at this level, and (depth, cell, spheres) to ask."""
    order = np.argsort(members["node_id"], kind="stable")
    ids, core = members["node_id"][order], members["core"][order]
    at, q = (np.column_stack([members[c][order] for c in cs]) for cs in (AXES, Q))
    n, extent = len(ids), np.array([leaf["ex"], leaf["ey"], leaf["ez"]])
    whole = n == leaf["n"]
    if whole and n <= 4:
        pairs, asked, enough = np.array([(i, j) for i in range(n) for j in range(i + 1, n)], int).reshape(-1, 2), [], True
    else:
        tets, centre, radius = tetrahedra(q, _corners(extent / 2, 1.0))
        pairs, asked, enough = _edges(tets, n), [], True
    pairs = pairs[core[pairs[:, 0]]] if len(pairs) else pairs  # an edge belongs to the leaf of its smaller id
    if not whole:
        star = np.append(core, [False] * 4)[tets].any(1)
        centre, radius = centre[star], radius[star]
        depth, own = leaf["depth"] - level, np.array([leaf[c] for c in CELL]) >> level
        enough = bool(depth == 0 or _contained(centre, radius, *_block(own, depth, 1, extent), extent).all())
        spheres = np.column_stack([centre, radius])
        for step in np.ndindex(3, 3, 3):
            cell = own + np.array(step) - 1
            if (cell < 0).any() or (cell >= 1 << depth).any() or (level == 0 and step == (1, 1, 1)):
                continue
            hit = _reaches(centre, radius, *_block(cell, depth, 0, extent))
            if hit.any():
                asked.append((depth, *cell.tolist(), spheres[hit].tobytes()))
    gap = np.sqrt(((at[pairs[:, 0]] - at[pairs[:, 1]]) ** 2).sum(1)) if len(pairs) else np.zeros(0)
    return {"u": ids[pairs[:, 0]] if len(pairs) else [], "v": ids[pairs[:, 1]] if len(pairs) else [], "distance": gap, "enough": enough}, asked


def _turns(members: DataFrame) -> DataFrame:
    """A row a leaf with its edges, and a row for each cell it asks."""
    id_type = members.schema["node_id"].dataType.simpleString()
    graph = members.schema["graph_id"].dataType.simpleString()
    names = [*LEAF, "level", "u", "v", "distance", "enough", "at_depth", "at_x", "at_y", "at_z", "spheres"]
    schema = f"graph_id {graph}, depth int, cx long, cy long, cz long, level int, u array<{id_type}>, v array<{id_type}>, distance array<double>, enough boolean, at_depth int, at_x long, at_y long, at_z long, spheres binary"

    def run(table: pa.Table) -> pa.Table:
        first = {c: table.column(c)[0].as_py() for c in [*LEAF, "level", *CARRIED]}
        told, asked = _turn(first, first["level"], {c: table.column(c).to_numpy() for c in ["node_id", "core", *AXES, *Q]}) if any(table.column("core").to_pylist()) else (None, [])
        head = [first[c] for c in LEAF] + [first["level"]]
        rows = [] if told is None else [[*head, np.asarray(told["u"]), np.asarray(told["v"]), told["distance"], told["enough"], *[None] * 5]]
        rows += [[*head, None, None, None, None, *a] for a in asked]
        kinds = {"graph_id": table.schema.field("graph_id").type, "depth": pa.int32(), "level": pa.int32(), "u": pa.list_(table.schema.field("node_id").type), "v": pa.list_(table.schema.field("node_id").type), "distance": pa.list_(pa.float64()), "enough": pa.bool_(), "at_depth": pa.int32(), "spheres": pa.binary()}
        return pa.table([pa.array([r[i] for r in rows], kinds.get(c, pa.int64())) for i, c in enumerate(names)], names=names)

    return members.groupBy(LEAF).applyInArrow(run, schema)


ASKED = ["at_depth", "at_x", "at_y", "at_z"]


def _violators(asked: DataFrame, points: DataFrame, counts: DataFrame, depths: list[int]) -> DataFrame:
    """Leaf and node: of each sphere the nodes deepest inside, as many as there are parts of its cells."""
    parts = counts.select("graph_id", F.col("depth").alias("at_depth"), *[F.col(c).alias(a) for c, a in zip(CELL, ASKED[1:])], F.ceil(F.col("n") / SALT).alias("salts"))
    bucket = ["graph_id", *ASKED, "salt"]
    asked = settled(asked.join(parts, ["graph_id", *ASKED]).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))), "asked")
    held = reduce(DataFrame.unionByName, [points.select("graph_id", F.lit(d).alias("at_depth"), *[c.alias(a) for c, a in zip(_cell(d), ASKED[1:])], "node_id", *AXES, *Q) for d in depths])
    held = held.join(parts, ["graph_id", *ASKED]).withColumn("salt", F.pmod(F.xxhash64("node_id"), F.col("salts"))).drop("salts")
    held = held.join(asked.select(bucket).distinct(), bucket, "left_semi")
    graph, node = (points.schema[c].dataType.simpleString() for c in ("graph_id", "node_id"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        q = np.column_stack([right.column(c).to_numpy() for c in Q])
        rows, found = [], []
        for i, blob in enumerate(left.column("spheres").to_pylist() if right.num_rows else []):
            spheres = np.frombuffer(blob).reshape(-1, 4)
            for j in range(0, len(spheres), 64):
                some = spheres[j : j + 64]
                power = ((q[None] - some[:, None, :3]) ** 2).sum(2) - (some[:, 3] * (1 - 1e-10))[:, None]
                deepest = power.argmin(1)
                for k in np.unique(deepest[power[np.arange(len(some)), deepest] < 0]).tolist():
                    rows.append(i)
                    found.append(k)
        out = left.select(LEAF).take(pa.array(rows, pa.int64()))
        for c in ["node_id", *AXES, *Q]:
            out = out.append_column(c, right.column(c).take(pa.array(found, pa.int64())))
        return out

    schema = f"graph_id {graph}, depth int, cx long, cy long, cz long, node_id {node}, " + ", ".join(f"{c} double" for c in [*AXES, *Q])
    return asked.select(*LEAF, *ASKED, "salt", "spheres").groupBy(bucket).cogroup(held.select(*bucket, "node_id", *AXES, *Q).groupBy(bucket)).applyInArrow(run, schema).distinct()


def edges(nodes: DataFrame) -> DataFrame:
    """graph_id, u, v (u < v), distance of the Delaunay edges of nodes (graph_id, node_id, coords) with finite coordinates.

    Of nodes in one place the smallest id stands for all. Fewer than five places are joined all with
    all; more places in one plane have no simplex and no edges, if the plane is one of two axes.
    """
    points = _placed(nodes)
    counts, deepest = _counts(points)
    leaves = _leaves(counts, deepest)
    depths = sorted(r["depth"] for r in leaves.select("depth").distinct().collect())  # at most DEPTH numbers
    members = settled(_members(points, leaves, depths).withColumn("level", F.lit(0)), "members")
    found = []
    while True:
        turn = settled(_turns(members), "turn")
        told = turn.filter("u is not null").select(*LEAF, "u", "v", "distance", "enough")
        asked = turn.filter("spheres is not null").select(*LEAF, *ASKED, "spheres")
        levels = sorted(r["at_depth"] for r in asked.select("at_depth").distinct().collect())
        if levels:
            met = _violators(asked, points, counts, levels)
            fresh = settled(met.join(members.select(*LEAF, "node_id"), [*LEAF, "node_id"], "left_anti"), "violators")
            open_ = settled(told.filter("not enough").select(LEAF).unionByName(fresh.select(LEAF)).distinct(), "open")
            told = told.join(open_, LEAF, "left_anti")
        found.append(told.select("graph_id", F.explode(F.arrays_zip("u", "v", "distance")).alias("e")).select("graph_id", "e.*"))
        if not levels or open_.isEmpty():
            return reduce(DataFrame.unionByName, found)
        kept = members.join(open_, LEAF, "left_semi")
        constant = kept.groupBy(*LEAF).agg(F.first("level").alias("level"), *[F.first(c).alias(c) for c in CARRIED])
        joined = kept.unionByName(fresh.withColumn("core", F.lit(False)).join(constant, LEAF).select(members.columns))
        members = settled(joined.withColumn("level", F.least(F.col("level") + 1, F.col("depth"))), "members")
