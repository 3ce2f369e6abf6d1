"""Node and edge labels. A node label is ``chain:residue:number[:atom]``; an edge is an unordered pair."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def code(c: Column) -> Column:
    return F.upper(F.trim(c))


def parsed(label: Column, granularity: str = "CA") -> list[Column]:
    """chain_id, residue_name, residue_number, atom_type, element_symbol of a label.

    Below atom granularity the granularity itself stands for the atom type; the element is the
    first character of the atom type. An insertion code behind the number isn't part of it.
    """
    parts = F.split(label, ":")
    atom = F.get(parts, F.lit(3)) if granularity == "atom" else F.lit(granularity)
    return [
        F.get(parts, F.lit(0)).alias("chain_id"),
        F.get(parts, F.lit(1)).alias("residue_name"),
        F.regexp_replace(F.get(parts, F.lit(2)), "[A-Za-z]$", "").try_cast("int").alias("residue_number"),
        atom.alias("atom_type"),
        F.substring(atom, 1, 1).alias("element_symbol"),
    ]


def endpoints(u: Column, v: Column) -> tuple[Column, Column]:
    return F.least(u, v), F.greatest(u, v)


def kind_set(kinds: Column) -> Column:
    return F.array_sort(F.array_distinct(kinds))
