"""Interactions at atom granularity: rings as centroids and planes, donors, acceptors and carbonyls by atom name.

Atoms are nodes (graph_id, node_id, coords, chain_id, residue_name, residue_number, atom_type).
Which atoms count and the cut-offs are a documented choice from published definitions. Edges join
atoms (u < v), those of rings the smallest node_id of each ring. Pairs come from neighbouring grid
cells, never from all atoms of a graph.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .construct import near_pairs, placed

# Names of ring atoms, and of atoms that give or take a hydrogen bond, in the public nomenclature.
RINGS = {
    "PHE": ("CG", "CD1", "CE1", "CZ", "CE2", "CD2"), "TYR": ("CG", "CD1", "CE1", "CZ", "CE2", "CD2"),
    "HIS": ("CG", "ND1", "CE1", "NE2", "CD2"), "TRP": ("CD2", "CE2", "CZ2", "CH2", "CZ3", "CE3"),
}
DONORS = {"ARG": ("NE", "NH1", "NH2"), "ASN": ("ND2",), "GLN": ("NE2",), "HIS": ("ND1", "NE2"), "LYS": ("NZ",), "SER": ("OG",), "THR": ("OG1",), "TRP": ("NE1",), "TYR": ("OH",)}
ACCEPTORS = {"ASN": ("OD1",), "ASP": ("OD1", "OD2"), "GLN": ("OE1",), "GLU": ("OE1", "OE2"), "HIS": ("ND1", "NE2"), "SER": ("OG",), "THR": ("OG1",), "TYR": ("OH",)}
RESIDUE = ["graph_id", "chain_id", "residue_number", "residue_name"]


def _named(table: dict[str, tuple[str, ...]]) -> Column:
    return reduce(lambda a, b: a | b, [(F.col("residue_name") == r) & F.col("atom_type").isin(*names) for r, names in table.items()])


def rings(atoms: DataFrame) -> DataFrame:
    """graph_id, node_id (the ring's smallest), coords (its centroid), normal (of length 1), one row for each complete ring.

    The normal is that of the plane through the centroid and the ring's first two atoms.
    """
    of = placed(atoms).filter(_named(RINGS))
    first = lambda i: F.max(F.when(F.col("atom_type") == reduce(lambda a, b: F.when(F.col("residue_name") == b[0], b[1][i]).otherwise(a), RINGS.items(), F.lit(None)), F.col("coords")))
    centre = [F.avg(F.get("coords", F.lit(i))) for i in range(3)]
    grouped = of.groupBy(*RESIDUE).agg(F.min("node_id").alias("node_id"), F.count_distinct("atom_type").alias("n"), F.array(*centre).alias("coords"), first(0).alias("a"), first(1).alias("b"))
    size = reduce(lambda a, b: F.when(F.col("residue_name") == b[0], len(b[1])).otherwise(a), RINGS.items(), F.lit(0))
    p, q = ([F.get(c, F.lit(i)) - F.get("coords", F.lit(i)) for i in range(3)] for c in "ab")
    cross = [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]
    whole = grouped.filter(F.col("n") == size).withColumn("cross", F.array(*cross))
    length = F.sqrt(F.aggregate("cross", F.lit(0.0), lambda s, x: s + x * x))
    return whole.withColumn("length", length).filter("length > 0").select("graph_id", "node_id", "coords", F.transform("cross", lambda x: x / F.col("length")).alias("normal"))


def _stacked(atoms: DataFrame, kind: str, reach: float, low: float, high: float) -> DataFrame:
    """Rings whose centroids are within reach and whose planes meet at an angle of low to high degrees."""
    pairs = near_pairs(rings(atoms), reach, ["normal"])
    dot = sum((F.get("u_normal", F.lit(i)) * F.get("v_normal", F.lit(i)) for i in range(1, 3)), F.get("u_normal", F.lit(0)) * F.get("v_normal", F.lit(0)))
    angle = F.degrees(F.acos(F.least(F.abs(dot), F.lit(1.0))))
    return pairs.withColumn("angle", angle).filter(F.col("angle").between(low, high)).select("graph_id", "u", "v", F.lit(kind).alias("kind"), "distance", "angle")


def pi_stacking(atoms: DataFrame, reach: float = 5.5, most: float = 30.0) -> DataFrame:
    return _stacked(atoms, "pi_stacking", reach, 0.0, most)


def t_stacking(atoms: DataFrame, reach: float = 7.0, least: float = 60.0) -> DataFrame:
    return _stacked(atoms, "t_stacking", reach, least, 90.0)


PLACE = ["chain_id", "residue_number", "residue_name"]


def _directed(atoms: DataFrame, kind: str, reach: float, gives: Column, takes: Column, apart: int) -> DataFrame:
    """Pairs of atoms, one that gives and one that takes, of residues at least ``apart`` numbers apart or of other chains."""
    marked = atoms.withColumns({"gives": F.coalesce(gives, F.lit(False)), "takes": F.coalesce(takes, F.lit(False))}).filter("gives or takes")
    pairs = near_pairs(marked, reach, ["gives", "takes", "chain_id", "residue_number"])
    far = (F.col("u_chain_id") != F.col("v_chain_id")) | (F.abs(F.col("u_residue_number") - F.col("v_residue_number")) >= apart)
    return pairs.filter("(u_gives and v_takes) or (v_gives and u_takes)").filter(far).select("graph_id", "u", "v", F.lit(kind).alias("kind"), "distance")


def hydrogen_bonds(atoms: DataFrame, reach: float = 3.5) -> DataFrame:
    """Donors (backbone N but proline's, and side chains) to acceptors (backbone O, and side chains) of residues not next to each other."""
    atom, residue = F.col("atom_type"), F.col("residue_name")
    return _directed(atoms, "hbond", reach, ((atom == "N") & (residue != "PRO")) | _named(DONORS), (atom == "O") | _named(ACCEPTORS), 2)


def carbonyls(atoms: DataFrame, reach: float = 3.2) -> DataFrame:
    """A backbone carbonyl's oxygen near the carbon of another residue's."""
    return _directed(atoms, "bb_carbonyl_carbonyl", reach, F.col("atom_type") == "O", F.col("atom_type") == "C", 1)
