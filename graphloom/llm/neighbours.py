"""Operator 6: approximate nearest neighbours by a forest of random-projection trees.

Trees are fitted on a bounded sample (``SAMPLE`` vectors at most) by splitting between two random
points; every vector of the table is then indexed in each tree. A query descends all trees through
one shared priority queue of margins until the leaves it has met hold ``search`` sample points (a
share of the index, if the table is larger than the sample). By default ``search`` is found on the
sample itself: so many that ``TARGET`` of the nearest sample points of some of them are met. The
candidates of these leaves are ranked exactly by cosine in double precision.

Vectors are stored once, in blocks of about ``BLOCK`` rows that are neighbours in the first tree. A
query goes to the blocks that hold a candidate of its, with the list of its leaves; there the rows
in one of these are ranked, each once.

Equal vectors are one entry with its ``k + 1`` smallest ids, which is all that k neighbours can
need; a third of all rows may be one vector. No bucket is capped.

Defined results: rows whose id or vector is null, or whose vector is zero, holds null or non-finite
components, take no part. Vectors of different lengths have no cosine: each length is searched
apart, with a forest of its own, and lengths without a query not at all. Ties go to the smaller id,
those of vectors of one direction too, as far as their cosines are equal in double precision. Rows
that repeat an id and a vector count once; rows of one id with other vectors are rows of their own,
each a query and a candidate. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.encode import dense

from .common import chunked, map_rows, quoted, saved

SAMPLE, TREES, LEAF, BLOCK, TARGET, CLOSE = 16_384, 16, 96, 4_096, 0.985, 1e-9


def usable(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0)


def fit(points: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 5) -> list[dict]:
    """Per tree: normals, offsets and children of its nodes (a child under 0 is leaf ~child) and sample points a leaf."""
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    forest = []
    for t in range(trees):
        rng = np.random.default_rng((seed, t))
        normals, offsets, children, sizes = [], [], [], []

        def grow(rows: np.ndarray) -> int:
            if len(rows) <= leaf:
                sizes.append(len(rows))
                return ~(len(sizes) - 1)
            a, b = unit[rng.choice(rows, 2, replace=False)]
            normal = a - b
            side = unit[rows] @ normal
            cut = float(np.median(side))
            right = side > cut
            if not right.any() or right.all():  # no plane parts them
                right = rng.random(len(rows)) < 0.5
                normal, cut = rng.normal(size=len(a)), 0.0
                right = unit[rows] @ normal > cut
                if not right.any() or right.all():
                    sizes.append(len(rows))
                    return ~(len(sizes) - 1)
            at = len(normals)
            normals.append(normal)
            offsets.append(cut)
            children.append([0, 0])
            children[at] = [grow(rows[~right]), grow(rows[right])]
            return at

        root = grow(np.arange(len(unit)))
        width = points.shape[1]
        forest.append({"root": root, "normals": np.array(normals, np.float32).reshape(-1, width), "offsets": np.array(offsets), "children": np.array(children, np.int64).reshape(-1, 2), "sizes": np.array(sizes)})
    return forest


def leaves(forest: list[dict], vectors: np.ndarray) -> np.ndarray:
    """Leaf of each vector in each tree."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = np.zeros((len(vectors), len(forest)), np.int64)
    for t, tree in enumerate(forest):
        node = np.full(len(unit), tree["root"])
        while (inner := np.flatnonzero(node >= 0)).size:
            at = node[inner]
            side = np.einsum("ij,ij->i", unit[inner], tree["normals"][at]) > tree["offsets"][at]
            node[inner] = tree["children"][at, side.astype(int)]
        out[:, t] = ~node
    return out


def probes(forest: list[dict], vector: np.ndarray, search: float) -> Iterator[tuple[int, int]]:
    """(tree, leaf) in the order of the queue that all trees share, until ``search`` sample points are met."""
    unit = vector / np.linalg.norm(vector)
    margins = [tree["normals"] @ unit - tree["offsets"] for tree in forest]
    queue = [(-np.inf, t, tree["root"]) for t, tree in enumerate(forest)]
    met = 0
    while queue and met < search:
        worst, t, node = heapq.heappop(queue)
        tree = forest[t]
        while node >= 0:
            margin = margins[t][node]
            near = int(margin > 0)
            heapq.heappush(queue, (max(worst, abs(margin)), t, tree["children"][node, 1 - near]))
            node = tree["children"][node, near]
        met += int(tree["sizes"][~node])
        yield t, int(~node)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision and in one order of summation."""
    dot = lambda x, y: (x * y).sum(1)
    return dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b)))


def needed(forest: list[dict], points: np.ndarray, k: int, target: float = TARGET, queries: int = 128) -> int:
    """Sample points to be met until a share ``target`` of the k nearest of some sample points have been."""
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    asked = np.linspace(0, len(points) - 1, min(queries, len(points))).astype(int)
    at, found = leaves(forest, points), []
    for i in asked:
        near = unit @ unit[i]
        near[i] = -np.inf
        missing, met = set(np.argsort(-near)[: min(k, len(points) - 1)].tolist()), 0
        for t, x in probes(forest, points[i], np.inf):
            met += int(forest[t]["sizes"][x])
            hit = [j for j in missing if at[j, t] == x]
            found += [met] * len(hit)
            missing -= set(hit)
            if not missing:
                break
    return int(np.quantile(found, target)) if found else 1


def nearest(df: DataFrame, is_query: Column, k: int = 5, id: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, trees: int = TREES, leaf: int = LEAF, search: int | None = None, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row under ``is_query`` its k nearest other rows found."""
    spark = df.sparkSession
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    kind = "array<float>" if df.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    raw = df.select(F.col(quoted(id)).cast("long").alias("id"), F.col(quoted(vector)).cast(kind).alias("v"), is_query.alias("q")).filter("id is not null and v is not null")
    rows = raw.filter(usable(F.col("v"))).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)).cast(kind))  # -0.0 is 0.0
    # one row a length
    lengths = sorted(r["n"] for r in raw.groupBy(F.size("v").alias("n")).agg(F.max("q").alias("asks")).filter("asks and n > 0").collect())
    found = [_of_one_length(rows.filter(F.size("v") == n), k, kind, sample, trees, leaf, search, block) for n in lengths]
    return reduce(DataFrame.unionByName, [x for x in found if x is not None] or [nothing])


def _of_one_length(rows: DataFrame, k: int, kind: str, sample: int, trees: int, leaf: int, search: int | None, block: int) -> DataFrame | None:
    """``nearest`` of rows (id, v, q) whose vectors are of one length; None if there are none."""
    spark = rows.sparkSession
    order = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    entries = rows.select("id", "v").distinct().withColumn("n", order).filter(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    # numbered by smallest id: one id may have several vectors
    entries = saved(dense(entries.withColumn("first", F.get("ids", F.lit(0))), ["first", "v"], "entry"), "entries")
    asked = rows.filter("q").select("id", "v").distinct()
    queries = saved(asked.select("v").distinct().join(entries.select("v", F.col("entry").alias("query")), "v"), "queries")

    total = entries.count()
    share = min(1.0, sample / max(total, 1))
    chosen = entries.filter(F.pmod(F.xxhash64("first", F.lit("sample")), F.lit(1 << 24)) < share * (1 << 24)).select("v").limit(2 * sample).toArrow()
    if not chosen.num_rows:
        return None
    points = np.array(chosen["v"].combine_chunks().flatten(), float).reshape(chosen.num_rows, -1)
    points = points[np.lexsort(points.T)]  # the forest doesn't depend on the order of rows
    grown = fit(points, trees, leaf)
    search = needed(grown, points, k) if search is None else search
    forest = spark.sparkContext.broadcast(grown)  # bounded by the sample
    first = np.cumsum([0] + [len(t["sizes"]) for t in grown])  # a leaf's code is its number over all trees

    def index(rows: Iterator[tuple]) -> Iterator[tuple]:
        for part in chunked(rows, 512):
            found = leaves(forest.value, np.array([r[1] for r in part])) + first[:-1]
            for (entry, v), at in zip(part, found, strict=True):
                yield entry, v, at.tolist()

    def search_(rows: Iterator[tuple]) -> Iterator[tuple]:
        for query, v in rows:
            yield query, v, [int(first[t]) + x for t, x in probes(forest.value, np.array(v), search)]

    wide = lambda r: 8 * len(r[1]) + 8 * len(r[2])
    stored = saved(map_rows(entries.select("entry", "v"), index, f"entry long, v {kind}, leaves array<int>", wide), "indexed")
    # leaves of the first tree, of which there are as many as the sample allows: some make a block, or one makes several
    sizes = {r["leaf"]: r["n"] for r in stored.groupBy(F.get("leaves", F.lit(0)).alias("leaf")).agg(F.count("*").alias("n")).collect()}
    spans, last, held = [], 0, 0
    for x in range(int(first[1])):
        n = sizes.get(x, 0)
        if held and held + n > block:
            last, held = last + 1, 0
        cut = max(1, -(-n // block))
        spans.append((x, last, cut))
        last, held = (last + cut, 0) if cut > 1 else (last, held + n)
    places = F.broadcast(spark.createDataFrame(spans, "leaf int, low int, cut int"))
    stored = stored.withColumn("leaf", F.get("leaves", F.lit(0))).join(places, "leaf").withColumn("block", (F.col("low") + F.pmod(F.xxhash64("entry"), F.col("cut"))).cast("int"))
    probing = saved(map_rows(queries.select("query", "v"), search_, f"query long, v {kind}, leaves array<int>", wide), "probes")
    held_by = stored.select("block", F.explode("leaves").alias("leaf")).distinct().groupBy("leaf").agg(F.collect_list("block").alias("blocks"))
    meets = probing.select("query", F.explode("leaves").alias("leaf")).join(held_by, "leaf").groupBy("query").agg(F.array_distinct(F.flatten(F.collect_set("blocks"))).alias("blocks"))
    sent = probing.join(meets, "query").select(F.explode("blocks").alias("block"), F.lit(True).alias("asks"), F.col("query").alias("key"), "v", "leaves")
    both = stored.select("block", F.lit(False).alias("asks"), F.col("entry").alias("key"), "v", "leaves").unionByName(sent)
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = both.repartition(parts, "block").sortWithinPartitions("block", "asks")
    codes = int(first[-1])

    def rank(rows: Iterator[tuple]) -> Iterator[tuple]:
        for _, group in groupby(rows, key=lambda r: r[0]):
            held, unit = [], None
            for _, asks, key, v, leaves_ in group:
                if not asks:
                    held.append((key, v, leaves_))
                    continue
                if not held:
                    break
                if unit is None:
                    keys, found, at = np.array([h[0] for h in held]), np.array([h[1] for h in held], float), np.array([h[2] for h in held])
                    unit = found / np.linalg.norm(found, axis=1, keepdims=True)
                wanted = np.zeros(codes, bool)
                wanted[leaves_] = True
                some = np.flatnonzero(wanted[at].any(1))
                if not len(some):
                    continue
                query = np.array(v, float)
                near = unit[some] @ (query / np.linalg.norm(query))
                if len(some) > k + 1:  # all that may be among the first k + 1, whatever the last bits of their scores
                    some = some[near >= np.partition(near, len(near) - k - 1)[len(near) - k - 1] - CLOSE]
                exact = cosine(np.broadcast_to(query, found[some].shape), found[some])
                for i in np.lexsort((keys[some], -exact))[: k + 1]:
                    yield key, int(keys[some[i]]), float(exact[i])

    pairs = map_rows(dealt, rank, "query long, entry long, score double")
    few = pairs.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "entry"))).filter(F.col("n") <= k + 1)
    by = Window.partitionBy("query").orderBy(F.desc("score"), "id", "entry")
    lists = few.join(entries.select("entry", F.explode("ids").alias("id")), "entry").withColumn("n", F.row_number().over(by)).filter(F.col("n") <= k + 1).groupBy("query").agg(F.sort_array(F.collect_list(F.struct("n", "id", "score", "entry"))).alias("found"))
    each = asked.join(queries, "v").select(F.col("id").alias("query_id"), "query").join(lists, "query")
    # the query's own row goes, by id and vector
    others = F.slice(F.filter("found", lambda x: (x["id"] != F.col("query_id")) | (x["entry"] != F.col("query"))), 1, k)
    ranked = each.select("query_id", F.posexplode(others).alias("p", "x"))
    return ranked.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
