"""Memberships as bitmaps: 64 ids of a dictionary a word, one row for each word that a graph has a bit in.

Graphs that are alike set bits in the same words, so set algebra over any number of graphs is an
aggregate of words, without one row a member: `bit_or` unites, `bit_and` intersects, `bit_count`
counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = 64


def words(members: DataFrame, id: str, *by: str) -> DataFrame:
    """The columns ``by`` of the members (graph_id, if none are named), word, bits. Members that are dealt out by some of these columns aren't shuffled."""
    bit = F.expr(f"shiftleft(1L, cast(pmod({id}, {WORD}) as int))")
    return members.groupBy(*(by or ["graph_id"]), F.floor(F.col(id) / WORD).alias("word")).agg(F.bit_or(bit).alias("bits"))


def ids(bitmaps: DataFrame, id: str) -> DataFrame:
    """The columns of the bitmaps but word and bits, with a row an id."""
    places = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.getbit("bits", i) == 1)
    return bitmaps.withColumn("_at", F.explode(places)).withColumn(id, F.col("word") * WORD + F.col("_at")).drop("_at", "word", "bits")


def counts(bitmaps: DataFrame, *by: str) -> DataFrame:
    """How many ids each group of bitmaps has; a word of a group is one row."""
    return bitmaps.groupBy(*by).agg(F.sum(F.bit_count("bits")).cast("long").alias("n"))


def union_of(members: DataFrame, id: str, groups: DataFrame) -> DataFrame:
    """What ``union`` gives, from memberships: they are shuffled to their groups, and no bitmaps of single graphs are made."""
    return words(members.select("graph_id", id).join(groups, "graph_id"), id, "group")


def union(bitmaps: DataFrame, groups: DataFrame) -> DataFrame:
    """group, word, bits: ids that any graph of a group has; ``groups`` is (graph_id, group)."""
    return bitmaps.join(groups, "graph_id").groupBy("group", "word").agg(F.bit_or("bits").alias("bits"))


def shared_by_all(bitmaps: DataFrame, groups: DataFrame) -> DataFrame:
    """group, word, bits: ids that every graph of a group has. A word that one of its graphs lacks is empty."""
    sizes = groups.groupBy("group").agg(F.countDistinct("graph_id").alias("_graphs"))
    met = bitmaps.join(groups.distinct(), "graph_id").groupBy("group", "word").agg(F.bit_and("bits").alias("bits"), F.count("*").alias("_n"))
    return met.join(sizes, "group").filter("_n = _graphs and bits <> 0").select("group", "word", "bits")


def overlap(bitmaps: DataFrame, with_: DataFrame) -> DataFrame:
    """graph_id, n: how many ids each graph shares with a set given as bitmaps (word, bits); graphs that share none are left out."""
    other = with_.groupBy("word").agg(F.bit_or("bits").alias("_other"))
    both = F.bit_count(F.col("bits").bitwiseAND(F.col("_other")))
    return bitmaps.join(other, "word").groupBy("graph_id").agg(F.sum(both).cast("long").alias("n")).filter("n > 0")
