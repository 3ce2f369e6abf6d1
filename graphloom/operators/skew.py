"""Joins that hold when one key has a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAVY = 1000


def by_group(rows: DataFrame, groups: DataFrame, key: list[str], n: str) -> DataFrame:
    """Left join of rows to the one row of their group, whose ``n`` tells how many rows have it.

    Both are stored or cheap to read twice. At most HEAVY groups hold a thousandth of all rows or more;
    those are broadcast, so that no key of the shuffle is common. A null in the key has no group.
    """
    least = rows.count() / HEAVY
    heavy, light = F.broadcast(groups.filter(F.col(n) > least)), groups.filter(F.col(n) <= least)
    return rows.join(heavy, key).unionByName(rows.join(heavy.select(key), key, "left_anti").join(light, key, "left"))
