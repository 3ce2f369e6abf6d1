"""Edge construction from coordinates.

Functions take nodes (graph_id, node_id, coords [, chain_id, residue_name, residue_number]) and
return edges (graph_id, u, v, kind, distance) with u < v. Joins are inside a graph; those with a
cut-off cut space of graphs with more than SMALL nodes into cells, so that a graph of any size is an
equi-join of neighbouring cells and never a product of all its nodes.

Residue classes and cut-offs of the chemical rules are a documented choice from published
definitions, in ``RULES``; change them by passing other rules.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import settled

#: Nodes of a graph up to which all its pairs are met, rather than its nodes sent to neighbouring cells.
SMALL = 512
AXES = ("x", "y", "z")
AROMATIC = ("PHE", "TRP", "HIS", "TYR")
POLAR = ("ARG", "ASN", "ASP", "GLN", "GLU", "HIS", "LYS", "SER", "THR", "TRP", "TYR")
ANY: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rule:
    """Residue classes of the two ends (either way round; empty: any) and a range of distance."""

    one: tuple[str, ...]
    other: tuple[str, ...]
    low: float
    high: float


RULES = {
    "aromatic": Rule(AROMATIC, AROMATIC, 4.5, 7.0),
    "aromatic_sulphur": Rule(AROMATIC, ("MET", "CYS"), 0.0, 5.3),
    "bb_carbonyl_carbonyl": Rule(ANY, ANY, 0.0, 3.2),
    "cation_pi": Rule(("LYS", "ARG"), ("PHE", "TYR", "TRP"), 0.0, 6.0),
    "disulfide": Rule(("CYS",), ("CYS",), 0.0, 2.2),
    "hbond": Rule(POLAR, POLAR, 0.0, 3.5),
    "hydrophobic": Rule(("ALA", "VAL", "LEU", "ILE", "MET", "PHE", "TRP", "PRO", "TYR"), ("ALA", "VAL", "LEU", "ILE", "MET", "PHE", "TRP", "PRO", "TYR"), 0.0, 5.0),
    "ionic": Rule(("ARG", "LYS", "HIS"), ("ASP", "GLU"), 0.0, 6.0),
    "salt_bridge": Rule(("ARG", "LYS"), ("ASP", "GLU"), 0.0, 4.0),
    "pi_stacking": Rule(AROMATIC, AROMATIC, 0.0, 5.5),
    "t_stacking": Rule(AROMATIC, AROMATIC, 5.5, 7.0),
}
# Van der Waals radii in angstrom by element.
RADII = {"C": 1.7, "N": 1.55, "O": 1.52, "S": 1.8, "P": 1.8, "H": 1.2}


def distance(a: str, b: str) -> Column:
    """Euclidean distance of two coordinate arrays of length 3."""
    d = [F.get(a, F.lit(i)) - F.get(b, F.lit(i)) for i in range(3)]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def placed(nodes: DataFrame) -> DataFrame:
    """Nodes with three finite coordinates; the others have no place and take no part in any edge."""
    known = F.col("coords").isNotNull() & (F.size("coords") == 3)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return nodes.filter(known & F.forall("coords", finite))


def _edges(pairs: DataFrame, kind: str | Column) -> DataFrame:
    return pairs.select("graph_id", "u", "v", (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), "distance")


def _by_size(nodes: DataFrame, extra: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """(graph_id, node_id, x, y, z and extra) of graphs of at most SMALL nodes, and of the larger ones, if there are any."""
    axes = [F.get("coords", F.lit(i)).alias(c) for i, c in enumerate(AXES)]
    points = placed(nodes).select("graph_id", "node_id", *axes, *extra)
    large = settled(points.groupBy("graph_id").agg(F.count("*").alias("n")).filter(F.col("n") > SMALL).select("graph_id"), "large")
    if large.isEmpty():
        return points, None
    return points.join(large, "graph_id", "left_anti"), points.join(large, "graph_id", "left_semi")


def _met(a: DataFrame, b: DataFrame, key: list[str], extra: list[str]) -> DataFrame:
    """Pairs u < v that agree in the key. Sides are merged: a table that is small on disk may be large in memory, and is not broadcast."""
    side = lambda df, s: df.select(*key, *[F.col(c).alias(f"{s}_{c}") for c in [*AXES, *extra]], F.col("node_id").alias(s))
    d = [F.col(f"u_{c}") - F.col(f"v_{c}") for c in AXES]
    pairs = side(a, "u").join(side(b, "v").hint("merge"), key).filter("u < v")
    return pairs.withColumn("distance", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])).select("graph_id", "u", "v", "distance", *[f"{s}_{c}" for s in "uv" for c in extra])


def near_pairs(nodes: DataFrame, reach: float, extra: list[str] = []) -> DataFrame:  # noqa: B006
    """Pairs u < v of a graph at most ``reach`` apart.

    Nodes of a graph of at most SMALL nodes meet each other, in one shuffle of the nodes. In larger graphs each
    node meets those of cells a little over twice as wide as ``reach``: its own, and on each axis the one on the
    nearer side, as no other can hold a node within reach.
    """
    small, large = _by_size(nodes, extra)
    near = _met(small, small, ["graph_id"], extra)
    if large is not None:
        width = F.lit(2.002 * reach or 1.0)
        own = large.withColumns({f"c_{c}": F.floor(F.col(c) / width) for c in AXES})
        asking = own
        for c in AXES:
            nearer = F.when(F.col(c) / width - F.col(f"c_{c}") < 0.5, F.col(f"c_{c}") - 1).otherwise(F.col(f"c_{c}") + 1)
            asking = asking.withColumn(f"c_{c}", F.explode(F.array(F.col(f"c_{c}"), nearer)))
        near = near.unionByName(_met(asking, own, ["graph_id", *[f"c_{c}" for c in AXES]], extra))
    return near.filter(F.col("distance") <= reach)


def fully_connected(nodes: DataFrame) -> DataFrame:
    points = placed(nodes).select("graph_id", "node_id", *[F.get("coords", F.lit(i)).alias(c) for i, c in enumerate(AXES)])
    return _edges(_met(points, points, ["graph_id"], []), "fully_connected")


def _far_in_chain(gap: int) -> Column:
    """Ends in other chains, or at least ``gap`` apart in the same one."""
    return (F.col("u_chain_id") != F.col("v_chain_id")) | (F.abs(F.col("u_residue_number") - F.col("v_residue_number")) >= gap)


CHAIN = ["chain_id", "residue_number"]


def distance_threshold(nodes: DataFrame, threshold: float = 6.0, long_interaction_threshold: int = 0) -> DataFrame:
    pairs = near_pairs(nodes, threshold, CHAIN if long_interaction_threshold else [])
    return _edges(pairs.filter(_far_in_chain(long_interaction_threshold)) if long_interaction_threshold else pairs, "distance_threshold")


def distance_window(nodes: DataFrame, low: float, high: float) -> DataFrame:
    return _edges(near_pairs(nodes, high).filter(F.col("distance") >= low), f"distance_window_{low:g}_{high:g}")


def knn(nodes: DataFrame, k: int = 3, long_interaction_threshold: int = 0) -> DataFrame:
    """Edges from each node to its k nearest, ties to the smaller id; an edge both ends choose is one."""
    from .knn import nearest

    extra = CHAIN if long_interaction_threshold else []
    allowed = _far_in_chain(long_interaction_threshold) if long_interaction_threshold else None
    near = nearest(placed(nodes), k, extra, allowed)
    return near.select("graph_id", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "distance").distinct().select("graph_id", F.col("a").alias("u"), F.col("b").alias("v"), F.lit("knn").alias("kind"), "distance")


def peptide_bonds(nodes: DataFrame) -> DataFrame:
    """Consecutive residue numbers of one chain."""
    small, large = _by_size(nodes, CHAIN)
    pairs = _met(small, small, ["graph_id"], CHAIN).filter((F.col("u_chain_id") == F.col("v_chain_id")) & (F.abs(F.col("u_residue_number") - F.col("v_residue_number")) == 1))
    if large is not None:
        number = F.col("residue_number")
        asking = large.withColumn("at", F.explode(F.array(number - 1, number + 1)))
        pairs = pairs.unionByName(_met(asking, large.withColumn("at", number), ["graph_id", "chain_id", "at"], ["residue_number"]), allowMissingColumns=True)
    return _edges(pairs, "peptide_bond")


def _ends(rule: Rule) -> Column:
    """Whether the residues of a pair are the rule's, either way round."""
    inside = lambda c, names: F.col(c).isin(*names) if names else F.lit(True)
    u, v = "u_residue_name", "v_residue_name"
    return (inside(u, rule.one) & inside(v, rule.other)) | (inside(v, rule.one) & inside(u, rule.other))


def by_rules(nodes: DataFrame, rules: dict[str, Rule] = RULES) -> DataFrame:
    """The edges of several rules, a row for each rule that a pair meets, from one search for pairs."""
    pairs = near_pairs(nodes, max(r.high for r in rules.values()), ["residue_name"])
    met = [F.when(F.col("distance").between(r.low, r.high) & _ends(r), F.lit(kind)) for kind, r in rules.items()]
    return pairs.select("graph_id", "u", "v", F.explode(F.array_compact(F.array(*met))).alias("kind"), "distance")


def by_rule(nodes: DataFrame, kind: str, rule: Rule | None = None) -> DataFrame:
    rule = rule or RULES[kind]
    useful = nodes.filter(F.col("residue_name").isin(*rule.one, *rule.other)) if rule.one and rule.other else nodes
    pairs = near_pairs(useful, rule.high, ["residue_name"]).filter(F.col("distance") >= rule.low)
    return _edges(pairs.filter(_ends(rule)), kind)


def contacts(nodes: DataFrame, slack: float, kind: str, low: float = float("-inf"), radii: dict[str, float] = RADII) -> DataFrame:
    """Pairs whose distance less the sum of their radii is in (low, slack]; nodes have ``element_symbol``."""
    table = F.create_map(*[F.lit(x) for kv in radii.items() for x in kv])
    sized = nodes.withColumn("radius", F.coalesce(table[F.col("element_symbol")], F.lit(radii["C"])))
    gap = F.col("distance") - (F.col("u_radius") + F.col("v_radius"))
    return _edges(near_pairs(sized, 2 * max(radii.values()) + slack, ["radius"]).filter((gap > low) & (gap <= slack)), kind)


def vdw(nodes: DataFrame, slack: float = 0.5) -> DataFrame:
    return contacts(nodes, slack, "vdw", 0.0)


def vdw_clashes(nodes: DataFrame) -> DataFrame:
    return contacts(nodes, 0.0, "vdw_clash")


def delaunay(nodes: DataFrame) -> DataFrame:
    """Edges of the 3-D Delaunay triangulation of each graph."""
    from .delaunay import edges

    return _edges(edges(placed(nodes)), "delaunay")


def combine(nodes: DataFrame, functions: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """graph_id, u, v, kinds (sorted set), distance: the union of several functions, one row an edge."""
    union = functions[0](nodes)
    for f in functions[1:]:
        union = union.unionByName(f(nodes))
    return union.groupBy("graph_id", "u", "v").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.min("distance").alias("distance"))


registry: dict[str, Callable[[DataFrame], DataFrame]] = {name: (lambda nodes, name=name: by_rule(nodes, name)) for name in RULES} | {
    "delaunay": delaunay, "knn": knn, "peptide_bond": peptide_bonds, "fully_connected": fully_connected, "distance_threshold": distance_threshold, "vdw": vdw, "vdw_clash": vdw_clashes,
}
