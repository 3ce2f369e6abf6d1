"""All registered queries of the graph store."""

from __future__ import annotations

from . import atom_queries, catalog, layer_queries, store_queries  # noqa: F401

QUERIES, ORACLE_SQL = catalog.QUERIES, catalog.ORACLE_SQL
