"""The order-graph overlay and its encoding restated in SQL, as common table expressions."""

from __future__ import annotations

from graphloom.functions.residues import DESCRIPTORS

_NAMES = ", ".join(f"'{r}'" for r in DESCRIPTORS)

ROWS = f"""
order_rows as (
  select 'O' || l_orderkey as graph_code, l_orderkey as seq,
    chr(65 + cast((l_partkey // 500) % 26 as int)) as chain_id, list_extract([{_NAMES}], cast(l_partkey % 21 as int) + 1) as residue_name,
    l_partkey as part, l_quantity as x, l_discount * 100 as y, l_tax * 100 as z, l_extendedprice as b_factor,
    row_number() over (partition by l_orderkey, l_partkey order by l_linenumber desc, l_suppkey desc, l_extendedprice desc, l_quantity desc, l_discount desc, l_tax desc, l_shipdate desc) as version
  from lineitem),
raw_nodes as materialized (
  select graph_code, seq, chain_id, residue_name, part, x, y, z, b_factor, chain_id || ':' || residue_name || ':' || part as node_label,
    row_number() over (partition by seq order by chain_id || ':' || residue_name || ':' || part) - 1 as pos
  from order_rows where version = 1)"""

EDGES = """,
raw_edges as materialized (
  select *, row_number() over (partition by seq order by u, v) - 1 as pos,
    'fully_connected' || case when distance <= 6 then ',near' else '' end || case when uc = vc then ',same_chain' else '' end as kinds
  from (
    select a.graph_code, a.seq, a.node_label as u, b.node_label as v, a.chain_id as uc, b.chain_id as vc,
      sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) as distance
    from raw_nodes a join raw_nodes b on a.seq = b.seq and a.node_label < b.node_label))"""

NODE_TABLES = """,
graphs as materialized (select graph_code, seq, row_number() over (order by seq, graph_code) - 1 as graph_id from (select graph_code, min(seq) as seq from raw_nodes group by graph_code)),
node_dict as materialized (
  select node_label, row_number() over (order by first.s, first.p) - 1 as node_id, split_part(node_label, ':', 1) as chain_id, split_part(node_label, ':', 2) as residue_name, cast(split_part(node_label, ':', 3) as int) as residue_number
  from (select node_label, min({'s': seq, 'p': pos}) as first from raw_nodes group by node_label)),
graph_nodes as materialized (select graph_id, node_id, x, y, z, b_factor, n.graph_code, n.seq, node_label from raw_nodes n join graphs using (graph_code) join node_dict using (node_label))"""

EDGE_TABLES = """,
edge_dict as materialized (
  select u as src_label, v as dst_label, row_number() over (order by first.s, first.p) - 1 as edge_id
  from (select u, v, min({'s': seq, 'p': pos}) as first from raw_edges group by u, v)),
graph_edges as materialized (select graph_id, edge_id, distance, kinds, e.graph_code, e.seq, u as src_label, v as dst_label from raw_edges e join graphs using (graph_code) join edge_dict d on d.src_label = e.u and d.dst_label = e.v)"""

VECTORS = """
vectors as (select cast(label as bigint) as graph_id, vec_id as node_id, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y, cast(embedding[3] as double) as z from embeddings),
pairs as (
  select a.graph_id, a.node_id as u, b.node_id as v, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) as distance
  from vectors a join vectors b on a.graph_id = b.graph_id and a.node_id <> b.node_id)"""


def nodes(select: str) -> str:
    return f"with {ROWS}{NODE_TABLES} {select}"


def edges(select: str) -> str:
    return f"with {ROWS}{EDGES}{NODE_TABLES}{EDGE_TABLES} {select}"


def raw(select: str) -> str:
    return f"with {ROWS} {select}"


def vectors(select: str) -> str:
    return f"with {VECTORS} {select}"
