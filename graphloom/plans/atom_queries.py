"""Queries at atom granularity, over atoms made of the parts: six parts a residue, forty residues a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import atoms, construct
from graphloom.sources.overlays import table

from .catalog import query

RESIDUES = ("PHE", "ASN", "TYR", "SER")
NAMES = (("CG", "CD1", "CE1", "CZ", "CE2", "CD2"), ("N", "CA", "C", "O", "OD1", "ND2"), ("CG", "CD1", "CE1", "CZ", "CE2", "CD2"), ("N", "S", "C", "O", "CB", "OG"))
#: Places of six atoms around the middle of a residue.
SPOTS = ((1.0, 0.0), (0.5, 0.875), (-0.5, 0.875), (-1.0, 0.0), (-0.5, -0.875), (0.5, -0.875))
MIDDLE = ((37, 101), (53, 89), (29, 97))  # multiplier and modulus of an axis
REACH = 12.0


def made(spark: SparkSession, d: str) -> DataFrame:
    n, r, k = F.col("p_partkey"), F.floor(F.col("p_partkey") / 6), F.col("p_partkey") % 6
    pick = lambda xs, i: F.get(F.array(*map(F.lit, xs)), i.cast("int"))
    names = by_residue(lambda i: pick(NAMES[i], k), r)
    a, b = pick([s[0] for s in SPOTS], k), pick([s[1] for s in SPOTS], k)
    middle = [(r * m % q).cast("double") * REACH / q for m, q in MIDDLE]
    # residues lie in one of three planes
    turn = r % 3
    at = [middle[0] + F.when(turn == 2, 0.0).otherwise(a), middle[1] + F.when(turn == 0, b).when(turn == 1, 0.0).otherwise(a), middle[2] + F.when(turn == 0, 0.0).otherwise(b)]
    return table(spark, d, "part").select(
        F.floor(r / 40).alias("graph_id"), n.alias("node_id"), F.array(*at).alias("coords"), F.when(r % 7 == 0, "B").otherwise("A").alias("chain_id"),
        pick(RESIDUES, r % 4).alias("residue_name"), r.cast("int").alias("residue_number"), names.alias("atom_type"), F.substring(names, 1, 1).alias("element_symbol"),
    )


def by_residue(of, r):
    out = of(0)
    for i in range(1, 4):
        out = F.when(r % 4 == i, of(i)).otherwise(out)
    return out


def _list(xs) -> str:
    return "[" + ", ".join(repr(x) for x in xs) + "]"


_A, _B = (f"{_list([s[j] for s in SPOTS])}[k + 1]::double" for j in range(2))
_M = [f"cast(r * {m} % {q} as double) * {REACH} / {q}" for m, q in MIDDLE]
ATOMS = f"""atoms as materialized (
  select r // 40 as graph_id, n as node_id, {_M[0]} + case when r % 3 = 2 then 0.0 else {_A} end as x, {_M[1]} + case r % 3 when 0 then {_B} when 1 then 0.0 else {_A} end as y, {_M[2]} + case when r % 3 = 0 then 0.0 else {_B} end as z,
    case when r % 7 = 0 then 'B' else 'A' end as chain, {_list(RESIDUES)}[r % 4 + 1] as residue, r as number, [{', '.join(map(_list, NAMES))}][r % 4 + 1][k + 1] as atom
  from (select p_partkey as n, p_partkey // 6 as r, p_partkey % 6 as k from part)),
apart as (
  select a.graph_id, a.node_id as u, b.node_id as v, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) as distance,
    a.chain as uc, b.chain as vc, a.number as un, b.number as vn, a.residue as ur, b.residue as vr, a.atom as ua, b.atom as va
  from atoms a join atoms b on a.graph_id = b.graph_id and a.node_id < b.node_id)"""


def _is(side: str, named: dict[str, tuple[str, ...]]) -> str:
    return "(" + " or ".join(f"({side}r = '{r}' and {side}a in ({', '.join(map(repr, names))}))" for r, names in named.items()) + ")"


def _gives(s: str) -> str:
    return f"(({s}a = 'N' and {s}r <> 'PRO') or {_is(s, atoms.DONORS)})"


def _takes(s: str) -> str:
    return f"({s}a = 'O' or {_is(s, atoms.ACCEPTORS)})"


@query(f"with {ATOMS} select graph_id, u, v, 'hbond' as kind, distance from apart where distance <= 3.5 and (uc <> vc or abs(un - vn) >= 2) and (({_gives('u')} and {_takes('v')}) or ({_gives('v')} and {_takes('u')}))")
def atoms_hydrogen_bonds(spark, d):
    return atoms.hydrogen_bonds(made(spark, d))


@query(f"with {ATOMS} select graph_id, u, v, 'bb_carbonyl_carbonyl' as kind, distance from apart where distance <= 3.2 and (uc <> vc or un <> vn) and ((ua = 'O' and va = 'C') or (ua = 'C' and va = 'O'))")
def atoms_carbonyls(spark, d):
    return atoms.carbonyls(made(spark, d))


# centroids of complete rings, and the plane through the first two atoms
PLANES = f"""with {ATOMS},
whole as (select graph_id, chain, number, residue, min(node_id) as node_id, avg(x) as x, avg(y) as y, avg(z) as z from atoms where residue in ('PHE', 'TYR') and atom in {NAMES[0]} group by all having count(distinct atom) = 6),
arms as (select w.*, a.x - w.x as ax, a.y - w.y as ay, a.z - w.z as az, b.x - w.x as bx, b.y - w.y as "by", b.z - w.z as bz from whole w
  join atoms a on a.graph_id = w.graph_id and a.chain = w.chain and a.number = w.number and a.atom = 'CG' join atoms b on b.graph_id = w.graph_id and b.chain = w.chain and b.number = w.number and b.atom = 'CD1'),
crossed as (select *, ay * bz - az * "by" as cx, az * bx - ax * bz as cy, ax * "by" - ay * bx as cz from arms),
rings as materialized (select *, sqrt(cx * cx + cy * cy + cz * cz) as l from crossed),
met as (select a.graph_id, least(a.node_id, b.node_id) as u, greatest(a.node_id, b.node_id) as v, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) as distance,
  degrees(acos(least(abs(a.cx / a.l * (b.cx / b.l) + a.cy / a.l * (b.cy / b.l) + a.cz / a.l * (b.cz / b.l)), 1))) as angle from rings a join rings b on a.graph_id = b.graph_id and a.node_id < b.node_id)
select graph_id, u, v, '{{kind}}' as kind, round(distance, 6) as distance, round(angle, 4) + 0.0 as angle from met where {{cond}}"""


def shown(df: DataFrame) -> DataFrame:
    return df.withColumns({"distance": F.round("distance", 6), "angle": F.round("angle", 4) + 0.0})


@query(PLANES.format(kind="pi_stacking", cond="distance <= 5.5 and angle <= 30"))
def atoms_pi_stacking(spark, d):
    return shown(atoms.pi_stacking(made(spark, d)))


@query(PLANES.format(kind="t_stacking", cond="distance <= 7 and angle >= 60"))
def atoms_t_stacking(spark, d):
    return shown(atoms.t_stacking(made(spark, d)))


_RADIUS = "(case {s}a[1] " + " ".join(f"when '{e}' then {r}" for e, r in construct.RADII.items()) + " end)::double"
_GAP = f"distance - ({_RADIUS.format(s='u')} + {_RADIUS.format(s='v')})"


@query(f"with {ATOMS} select graph_id, u, v, 'vdw' as kind, distance from apart where {_GAP} > 0 and {_GAP} <= 0.5")
def atoms_vdw(spark, d):
    """Of four elements."""
    return construct.vdw(made(spark, d))


@query(f"with {ATOMS} select graph_id, u, v, 'vdw_clash' as kind, distance from apart where {_GAP} <= 0")
def atoms_vdw_clash(spark, d):
    return construct.vdw_clashes(made(spark, d))
