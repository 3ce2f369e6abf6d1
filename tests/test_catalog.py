"""Every registered query of the graph store against its SQL, over the smallest driver tables."""

import os

import duckdb
import pytest

from graphloom.plans.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are absent")
TABLES = "lineitem orders part events embeddings".split()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = con.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)


def test_every_query_has_sql_but_those_that_cannot():
    assert set(QUERIES) - set(ORACLE_SQL) == {"edges_delaunay", "footprint_serialized"}


@pytest.mark.parametrize("name", ["insert_incremental", "merge_last_wins"])
def test_whole_table(spark, name):
    graphs = QUERIES["graph_catalog"](spark, DATA).count()
    assert QUERIES[name](spark, DATA).select("graph_code").distinct().count() == graphs > 400


def test_complete_edge_list_of_all_graphs(spark):
    sizes = QUERIES["node_membership"](spark, DATA).groupBy("graph_id").count().collect()
    got = {r.graph_id: r["count"] for r in QUERIES["complete_edge_list"](spark, DATA).groupBy("graph_id").count().collect()}
    assert got == {r.graph_id: r["count"] * (r["count"] - 1) for r in sizes if r["count"] > 1} and len(got) > 400
