"""Data set preparation: sampling, classes, splits, batches. All picks are hash-seeded, so reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .encode import dense
from .lineage import settled

SUPERFAMILY = r"^([a-z]\.\d+\.\d+)"


TICKETS = 2_147_483_647  # a prime, so that keys below it have different tickets


def ticket(key: Column, seed: int) -> Column:
    """A pseudorandom number below TICKETS of an integer key, that any SQL engine can restate."""
    return F.pmod(F.pmod(F.pmod(key, F.lit(TICKETS)) * 48_271 + F.lit(seed) * 104_729, F.lit(TICKETS)) * 16_807 + 11, F.lit(TICKETS))


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return df.orderBy(ticket(F.col(key), seed), key).limit(n)


def head(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def extracted(c: Column, pattern: str = SUPERFAMILY) -> Column:
    """First group of the pattern; NULL where there is none."""
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def label_encode(df: DataFrame, c: str, name: str) -> DataFrame:
    """Sorted distinct values as 0, 1, ...; ranks are taken over the distinct values only, in ranges, and joined back."""
    values = df.select(c).distinct().filter(F.col(c).isNotNull())
    return df.join(dense(values, [c], name).withColumn(name, F.col(name).cast("int")), c, "left")


def value_counts(df: DataFrame, c: str) -> DataFrame:
    return df.groupBy(c).agg(F.count("*").alias("n"))


def frequent(df: DataFrame, c: str, least: int = 6) -> DataFrame:
    return df.join(value_counts(df, c).filter(F.col("n") >= least), c, "left_semi")


def without(df: DataFrame, key: str, obsolete: DataFrame) -> DataFrame:
    return df.join(obsolete.select(F.col(obsolete.columns[0]).alias(key)), key, "left_anti")


def replaced(df: DataFrame, key: str, moved: DataFrame, steps: int = 64) -> DataFrame:
    """df with each key replaced by what ``moved`` (old, new) names in its place, as long as that is replaced too.

    Chains are halved by pointer jumping, so ``steps`` rounds follow any chain; a ring raises. Of several
    replacements of one key the smallest counts.
    """
    last = settled(moved.filter("old is not null and new is not null and old <> new").groupBy("old").agg(F.min("new").alias("new")), "moved")
    for _ in range(steps):
        further = last.join(last.select(F.col("old").alias("new"), F.col("new").alias("next")), "new", "left")
        if further.filter("next is not null").isEmpty():
            to = last.select(F.col("old").alias(key), F.col("new").alias("_new"))
            return df.join(to, key, "left").withColumn(key, F.coalesce("_new", key)).select(df.columns)
        if not further.filter("next = old").isEmpty():
            break
        last = settled(further.select("old", F.coalesce("next", "new").alias("new")), "moved")
    raise ValueError("a key is replaced by itself, over other keys")


def stratified(df: DataFrame, cls: str, key: str, shares: tuple[float, float] = (0.70, 0.15), seed: int = 42, rows_a_range: int = 50_000) -> DataFrame:
    """df with ``split`` train / valid / test by rank inside each class.

    Ranks inside a class are taken in ranges of tickets, as many as the rows of df need, so a class
    of any size is ranked by many tasks.
    """
    ranges = max(32, df.count() // rows_a_range)
    rows = df.withColumn("_t", ticket(F.col(key), seed)).withColumn("_b", F.floor(F.col("_t") * ranges / TICKETS))
    per = rows.groupBy(cls, "_b").agg(F.count("*").alias("_n"))
    over = Window.partitionBy(cls)
    per = per.select(cls, "_b", (F.sum("_n").over(over.orderBy("_b")) - F.col("_n")).alias("_before"), F.sum("_n").over(over).alias("_all"))
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(cls, "_b").orderBy("_t", key)) - 1)
    join = [ranked[cls].eqNullSafe(per[cls]), ranked["_b"] == per["_b"]]
    placed = ranked.join(per, join).select(ranked["*"], ((F.col("_before") + F.col("_r")) / F.col("_all")).alias("_q"))
    split = F.when(F.col("_q") < shares[0], "train").when(F.col("_q") < sum(shares), "valid").otherwise("test")
    return placed.withColumn("split", split).drop("_t", "_b", "_r", "_q")


def ordered_split(df: DataFrame, key: str, shares: tuple[float, float] = (0.8, 0.1), seed: int = 42) -> DataFrame:
    """Shuffled split over all rows: the stratified one with a single class."""
    return stratified(df.withColumn("_one", F.lit(0)), "_one", key, shares, seed).drop("_one")


def batches(df: DataFrame, order: list[str], size: int = 16, drop_last: bool = True) -> DataFrame:
    """df with ``batch``; the last one goes if it isn't full."""
    ranked = dense(df, order, "_rank").withColumn("batch", F.floor(F.col("_rank") / size))
    if drop_last:
        full = ranked.groupBy("batch").agg(F.count("*").alias("_n")).filter(F.col("_n") == size)
        ranked = ranked.join(full, "batch", "left_semi")
    return ranked.drop("_rank")


def attach(df: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    return df.join(labels, key)


def complete(nodes: DataFrame, sizes: DataFrame, key: str = "graph_code") -> DataFrame:
    """Codes of graphs that have nodes, and coordinates for each of them. Nodes name their graph by ``key``: by its id they need no code."""
    placed = nodes.groupBy(key).agg(F.count(F.when(F.size("coords") == 3, 1)).alias("n_coords"))
    return sizes.join(placed, key).filter("n_nodes > 0 and n_coords = n_nodes").select("graph_code", "n_nodes")
