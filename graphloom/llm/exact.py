"""Operator 12: exact dedup by progressive refinement.

Rows are grouped by length, then by a hash of the first bytes, then by a hash of the whole text; a
row leaves as soon as its group has no other. Length and prefix hash make a narrow sketch of one
scan, on which the first two levels are aggregated. The second scan hashes whole texts only of rows
whose (length, prefix hash) others share. What it needs to know of the first levels is told by
``SLOTS`` numbered slots, a table of bounded size whatever the corpus: a slot that is taken for
another key costs a hash of one text more and never a wrong result.

Texts never move: both scans send ids, lengths and hashes alone. Whole texts are told apart by
length and SHA-256.

Defined results: null text counts as empty, so nulls and empty texts are one group. Of equal texts
the row of the largest id stays, a null id being the smallest; of rows equal in id and text one
stays. Every row comes out, repeated ones too; an empty table gives none. Texts of any length are
hashed whole. Columns named in ``carry`` come along, others are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, by_group, quoted, saved

PREFIX, SLOTS = 256, 1 << 20


def _slot(*key: Column) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(SLOTS))


def _shared(groups: DataFrame, *key: str) -> DataFrame:
    """Slots of the keys that two rows or more have: at most SLOTS rows of one number."""
    return F.broadcast(groups.filter("_n > 1").select(_slot(*map(F.col, key)).alias("_slot")).distinct())


def duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), prefix: int = PREFIX) -> DataFrame:
    """One row per row of df: id, carried columns, keep_id, group_size, kept."""
    data = as_bytes(quoted(text))
    size, head = F.octet_length(data), F.xxhash64(F.substring(data, 1, prefix))
    sketch = saved(df.select(size.alias("_size"), head.alias("_head")), "sketch")
    # level 1: lengths that two texts or more have; level 2: prefixes, among the texts of such lengths
    lengths = sketch.groupBy("_size").agg(F.count("*").alias("_n"))
    alike = sketch.withColumn("_slot", _slot(F.col("_size"))).join(_shared(lengths, "_size"), "_slot", "left_semi")
    prefixes = alike.groupBy("_size", "_head").agg(F.count("*").alias("_n"))
    # level 3: whole texts of such prefixes; other rows are alone and need no hash
    open_ = _shared(saved(prefixes.filter("_n > 1"), "prefixes"), "_size", "_head").withColumn("_open", F.lit(True))
    rows = df.select(F.col(quoted(id)).alias("_id"), *[F.col(quoted(c)).alias(f"_carry{i}") for i, c in enumerate(carry)], size.alias("_size"), data.alias("_data"), _slot(size, head).alias("_slot"))
    full = F.when(F.col("_open"), F.unhex(F.sha2("_data", 256)))
    told = rows.join(open_, "_slot", "left").select("_id", *[f"_carry{i}" for i in range(len(carry))], "_size", full.alias("_full"), F.monotonically_increasing_id().alias("_row"))
    told = saved(told, "hashes")
    found = told.filter("_full is not null").groupBy("_size", "_full").agg(F.max(F.struct("_id", "_row")).alias("_last"), F.count("*").alias("_n")).filter("_n > 1")
    grouped = by_group(told, found, ["_size", "_full"], "_n")
    alone = F.col("_n").isNull()
    return grouped.select(
        F.col("_id").alias(id), *[F.col(f"_carry{i}").alias(c) for i, c in enumerate(carry)],
        F.when(alone, F.col("_id")).otherwise(F.col("_last._id")).alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("_last._row") == F.col("_row"))).alias("kept"),
    )
