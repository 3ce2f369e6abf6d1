"""Operator 3: Jaccard join of word-shingle sets by chosen paths.

Sets are split recursively on sampled shared tokens: a set goes to a node for each of its tokens
whose hash falls under ``PATHS / size``, so two sets meet at tokens they share. A node of up to
``LEAF`` sets is compared by brute force; a larger one is split again on tokens not yet on its
path, and one that is still larger after ``DEPTH`` splits is compared in pairs of blocks. Every set
of a split node goes on to one child at least; one without a token left is compared with all sets
of the node that have a similar size. Runs start from disjoint shares of a set's ``PATHS`` sampled
tokens; after a run its links are joined into groups, and the next run skips nodes that lie in one
group. With 16 starts, two sets of similarity 0.8 meet in no node with a probability of about
exp(-0.8 * 16), under 3 in a million. Where nodes were split, two sets may part again: from the
number of a set's starts in such nodes, ``more_draws`` says how often it starts anew, with fresh
tokens and fresh children, until no more than that (``MISS``) have met in no leaf.

Comparison in a node uses a token sample and only links what may be similar. The connected groups
of these links are then joined exactly on whole sets, in blocks, each pair once. So a link that no
path found, but whose ends are in one group, counts too, and no false link remains.

Equal sets are one set with a count from the start. Defined results: texts of 1 to 4 words are one
shingle; texts without a word (null, empty) are a class of their own without links. Repeated rows
and rows with a null id are ordinary copies; the class id is the smallest id that isn't null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, as_bytes, map_rows, mix, quoted, row_key, saved, shingle_hashes, word_hashes
from .components import components

WORDS, SIMILARITY = 5, 0.8
PATHS, SAMPLE, CHILDREN, LEAF, DEPTH, BLOCK = 16, 32, 1.25, 2_048, 5, 512
#: Shares of the start tokens (of 16) that the runs of the first draw take; later draws are one run.
RUNS, WHOLE = ((0, 4), (4, 16)), (0, 16)
MISS = 3e-6
_ORDER = U64(0x5851F42D4C957F2D)


def token_set(data: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(shingle_hashes(word_hashes(data.split()), words))


def kept(tokens: float, shared: float, splits: int) -> float:
    """Share of the pairs met at a start that are still together after ``splits`` splits of its node.

    A pair stays together if both go to a child of a shared token: a token under ``CHILDREN`` / size of
    both, or the first of their tokens in hash order if neither has one.
    """
    out = 1.0
    for k in range(splits, 0, -1):
        both, left = shared - k, tokens - k
        if both <= 0:
            out = 1.0  # one set has no token left, so it is compared in its node
            continue
        either = 2 * left - both
        out = 1 - math.exp(-CHILDREN * both / left * out) + math.exp(-CHILDREN * either / left) * both / either * out
    return out


def survival(splits: int, similarity: float) -> list[float]:
    """By the size of a set (the last: any over PATHS), the least :func:`kept` of its pairs at the threshold; pairs of one set in the other are the hardest."""

    def least(n: int) -> float:
        pairs = [(m, math.ceil(similarity * m - 1e-9)) for m in range(n, math.floor(n / similarity + 1e-9) + 1)]
        return min([kept(m, both, splits) for m, both in pairs if 0 < both < m], default=1.0)

    return [*(least(n) for n in range(PATHS + 1)), kept(PATHS, similarity * PATHS, splits)]


def more_draws(splits: int, similarity: float, n: Column, starts: Column, split: Column) -> Column:
    """How often a set of n tokens starts anew, if nodes of ``split`` of its ``starts`` were split, so that it has met each set at the threshold in a leaf but for a share MISS.

    A start in a node that wasn't split has met all that share it. Of a set that started from all its
    tokens, a pair shares one of these for sure if they are more than what the pair may differ in.
    Of another, each start is shared with a probability of ``similarity`` at least.
    """
    stay, goal = survival(splits, similarity), -math.log(MISS)
    gain = lambda x: -math.log1p(-min(x, 1 - 1e-12))
    shared = [math.ceil(similarity * size - 1e-9) for size in range(PATHS + 1)]
    differ = [size - both for size, both in enumerate(shared)]
    again = [max(0, math.ceil(goal / max(1e-9, both * gain(x)) - 1e-9) - 1) for both, x in zip(shared, stay[:-1], strict=True)]
    of = lambda values: F.get(F.lit(values), n)
    short = F.when(starts - split > of(differ), 0).otherwise(of(again))
    had = (starts - split) * gain(similarity) + split * gain(similarity * stay[-1])
    long = F.greatest(F.lit(0), F.ceil((F.lit(goal) - had) / (similarity * PATHS * stay[-1]) - 1e-9))
    return F.when(n <= PATHS, short).otherwise(long).cast("int")


def _under(tokens: np.ndarray, ranks: np.ndarray, expected: int) -> np.ndarray:
    if len(tokens) <= expected:
        return tokens
    return tokens[ranks < U64(int(expected / len(tokens) * 2.0**64))]


def sets_of(df: DataFrame, id: str, text: str, words: int) -> DataFrame:
    """doc, tie, set (128-bit hash, null for no words), n, roots (tokens to start paths from), sample."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc, tie, data in rows:
            tokens = token_set(data, words)
            if not len(tokens):
                yield doc, tie, None, 0, None, None
                continue
            ranks = mix(tokens ^ _ORDER)
            yield doc, tie, xxhash.xxh3_128_digest(tokens.tobytes()), len(tokens), _under(tokens, ranks, PATHS).view(np.int64).tolist(), _under(tokens, ranks, SAMPLE).tobytes()

    rows = texts_of(df, id, text)
    kind = rows.schema["doc"].dataType.simpleString()
    return map_rows(rows, run, f"doc {kind}, tie long, set binary, n int, roots array<long>, sample binary")


def texts_of(df: DataFrame, id: str, text: str) -> DataFrame:
    return df.select(F.col(quoted(id)).alias("doc"), F.xxhash64(quoted(text)).alias("tie"), as_bytes(quoted(text)).alias("data"))


def drawn_anew(texts: DataFrame, due: DataFrame, words: int) -> DataFrame:
    """(set, draw, roots) of draws have + 1 to want.

    A set of up to SAMPLE tokens starts from all of them again. Draw 1 of another starts from its whole
    sample, which holds as many fresh tokens as the first draw took; later ones go back to the text.
    """

    def sampled(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, n, sample, have, want in rows:
            for draw in range(have + 1, (want if n <= SAMPLE else min(want, 1)) + 1):
                yield key, draw, np.frombuffer(sample, np.int64).tolist()

    def read(rows: Iterator[tuple]) -> Iterator[tuple]:
        for data, key, have, want in rows:
            tokens = token_set(data, words)
            for draw in range(max(have, 1) + 1, want + 1):
                yield key, draw, _under(tokens, mix(mix(tokens ^ _ORDER) ^ U64(draw)), PATHS).view(np.int64).tolist()

    schema = "set binary, draw int, roots array<long>"
    first = map_rows(due.select("set", "n", "sample", "have", "want"), sampled, schema)
    rest = due.filter((F.col("n") > SAMPLE) & (F.col("want") > 1)).select("set", "have", "want", F.col("holder.doc").alias("doc"), F.col("holder.tie").alias("tie"))
    if rest.limit(1).count() == 0:
        return first
    held = texts.alias("t").join(rest.alias("w"), F.col("t.doc").eqNullSafe(F.col("w.doc")) & (F.col("t.tie") == F.col("w.tie")))
    return first.unionByName(map_rows(held.select("t.data", "w.set", "w.have", "w.want"), read, schema).dropDuplicates(["set", "draw"]))


def _labels(linked: np.ndarray) -> np.ndarray:
    """Component of each row of a boolean matrix: the smallest row number in it."""
    label = np.arange(len(linked))
    while True:
        low = label.copy()
        for i in range(0, len(label), 256):
            low[i : i + 256] = np.minimum(low[i : i + 256], np.where(linked[i : i + 256], label[None, :], len(label)).min(1))
        low = np.minimum(low, low[low])
        if (low == label).all():
            return label
        label = low


def _shared(sets: list[np.ndarray], cells: int = 1 << 22, tokens: int = 1 << 20) -> np.ndarray:
    """Sizes of all intersections: products of 0/1 matrices over ranges of the tokens.

    Sets are sorted, so a range of token values is a slice of each; ranges hold about ``tokens``
    tokens and matrices ``cells`` cells, whatever the number and length of the sets.
    """
    out = np.zeros((len(sets), len(sets)), np.float32)
    parts = max(1, sum(map(len, sets)) // tokens)
    edges = [np.searchsorted(s, np.array([(1 << 64) // parts * i for i in range(1, parts)], U64)) for s in sets]
    for i in range(parts):
        held = [s[(e[i - 1] if i else 0) : (e[i] if i < parts - 1 else len(s))] for s, e in zip(sets, edges, strict=True)]
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in held])
        values, column = np.unique(np.concatenate(held), return_inverse=True)
        kept = np.bincount(column, minlength=len(values)) > 1  # a token of one set is in no intersection
        column, owner, columns = (np.cumsum(kept) - 1)[column[kept[column]]], owner[kept[column]], int(kept.sum())
        order, step = np.argsort(column, kind="stable"), max(1, cells // len(sets))
        column, owner = column[order], owner[order]
        for low in range(0, columns, step):
            a, b = np.searchsorted(column, (low, low + step))
            m = np.zeros((len(sets), min(step, columns - low)), np.float32)
            m[owner[a:b], column[a:b] - low] = 1
            for j in range(0, len(sets), 512):
                out[j : j + 512] += m[j : j + 512] @ m.T
    return out


def _candidates(members: list[tuple], similarity: float) -> Iterator[tuple[bytes, bytes]]:
    """New links between the groups of a node's sets whose samples may be similar; members: (set, label, n, sample)."""
    samples = [np.frombuffer(m[3], U64) for m in members]
    size = np.array([m[2] for m in members], float)
    k = np.array([len(s) for s in samples], float)
    both = _shared(samples)
    alike = np.zeros(both.shape, bool)
    for i in range(0, len(members), 256):
        some = slice(i, i + 256)
        alike[some] = both[some] >= 0.5 * np.maximum(k[some, None], k[None, :])
        alike[some] &= np.minimum(size[some, None], size[None, :]) >= similarity * np.maximum(size[some, None], size[None, :]) - 1e-9
    del both
    labels = [m[1] for m in members]
    _, group = np.unique(np.array([int.from_bytes(x[:8]) for x in labels], U64), return_inverse=True)
    order = np.argsort(group, kind="stable")
    same = order[1:][group[order[1:]] == group[order[:-1]]], order[:-1][group[order[1:]] == group[order[:-1]]]
    alike[same] = alike[same[::-1]] = True
    yield from {(labels[i], labels[root]) for i, root in enumerate(_labels(alike)) if labels[i] != labels[root]}


def _blocks(df: DataFrame, size: str, member: str, block: int) -> DataFrame:
    """Groups over ``block`` rows become pairs of blocks (i, j), i <= j; a row goes to each pair with its own."""
    n = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64(member), n).cast("int")
    other = F.explode(F.sequence(F.lit(0), n - 1))
    dealt = df.withColumn("_own", own).withColumn("_other", other)
    return dealt.withColumn("i", F.least("_own", "_other")).withColumn("j", F.greatest("_own", "_other")).drop("_other")


def paths(sets: DataFrame, starts: DataFrame, labels: DataFrame | None, run: tuple[int, int], similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame | None, int]:
    """(node, i, j, set, label) of the nodes of a run that hold sets of more than one group, large ones in pairs of blocks; (node, set) of starts whose nodes were split; the number of splits.

    starts: (set, draw, roots) of the sets that take part. labels: (node, label) of the groups known so
    far; a set without one is its own group.
    """
    label = F.col("set") if labels is None else F.coalesce("label", "set")
    known = starts if labels is None else starts.join(labels.withColumnRenamed("node", "set"), "set", "left")
    share = lambda t: F.pmod(F.xxhash64(t, F.lit("run")), F.lit(16)).between(run[0], run[1] - 1)
    level = known.select("set", "draw", label.alias("label"), F.explode(F.filter("roots", share)).alias("node")).withColumn("path", F.array("node"))
    level = level.withColumn("node", F.when(F.col("draw") == 0, F.col("node")).otherwise(F.xxhash64("node", "draw")))  # children depend on the node, so they are fresh too
    leaves, crowded = None, None
    columns = ("node", "i", "j", "set", "label")
    for depth in range(DEPTH + 1):
        counts = level.groupBy("node").agg(F.count("*").alias("m"), F.min("label").alias("low"), F.max("label").alias("high")).filter("m > 1 and low <> high").select("node", "m")
        met = saved(level.join(counts, "node"), "paths")
        done = met if depth == DEPTH else met.filter(F.col("m") <= LEAF)
        done = _blocks(done, "m", "set", LEAF).select(*columns)
        leaves = done if leaves is None else leaves.unionByName(done)
        large = met.filter(F.col("m") > LEAF)
        if depth == DEPTH or large.limit(1).count() == 0:
            break
        crowded = large.select("node", "set") if crowded is None else crowded
        left = large.join(starts, ["set", "draw"]).withColumn("left", F.array_except("roots", "path"))
        ended = left.filter(F.size("left") == 0).select("node", "set", "label", "m")
        if ended.limit(1).count():
            leaves = leaves.unionByName(_against_all(saved(ended, "ended"), large, sets, similarity, depth).select(*columns))
        rank = lambda t: F.pmod(F.xxhash64("node", t, F.lit("pick")), F.lit(1 << 30))
        ranked = left.withColumn("first", F.array_min(F.transform("left", rank)))
        picked = F.filter("left", lambda t: (rank(t) * F.size("left") < int(CHILDREN * (1 << 30))) | (rank(t) == F.col("first")))
        level = ranked.withColumn("token", F.explode(picked)).select(F.xxhash64("node", "token").alias("node"), "set", "draw", "label", F.concat("path", F.array("token")).alias("path"))
    return leaves, crowded, 0 if crowded is None else depth


def _split_starts(crowded: DataFrame, groups: DataFrame) -> DataFrame:
    """(set, split): how many starts of a set lie in split nodes that hold sets of more than one group by now."""
    label = F.coalesce("label", "set")
    known = crowded.join(groups.withColumnRenamed("node", "set"), "set", "left").select("node", "set", label.alias("label"))
    many = known.groupBy("node").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("node")
    return known.join(many, "node").groupBy("set").agg(F.count("*").cast("int").alias("split"))


def _against_all(ended: DataFrame, large: DataFrame, sets: DataFrame, similarity: float, depth: int) -> DataFrame:
    """Sets without a token left, in blocks, each with every block of the sets of its node that may be similar by size."""
    n = sets.select("set", "n")
    alone = ended.join(n, "set")
    bounds = alone.groupBy("node").agg(F.count("*").alias("e"), (F.min("n") * similarity - 1e-6).alias("low"), (F.max("n") / similarity + 1e-6).alias("high"))
    others = large.join(bounds, "node").join(n, "set").filter("n between low and high")
    cut = lambda c: F.ceil(F.col(c) / LEAF).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), cut(c) - 1))
    own = lambda c: F.pmod(F.xxhash64("set"), cut(c)).cast("int")
    node = F.xxhash64("node", F.lit("ended"), F.lit(depth)).alias("node")
    one = alone.join(bounds.select("node", "e"), "node").withColumn("i", own("e")).withColumn("j", every("m"))
    all_ = others.withColumn("i", every("e")).withColumn("j", own("m"))
    return one.select(node, "i", "j", "set", "label").unionByName(all_.select(node, "i", "j", "set", "label"))


def jaccard_join(df: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row per input row: id, tie (hash of the text), class_id, n_links (other rows at that similarity or more), class_key.

    class_key tells classes apart even where rows of several share an id; it is null for texts without a word.
    """
    parts = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows, texts = saved(sets_of(df, id, text, words), "sets"), texts_of(df, id, text)
    some = rows.filter("set is not null")
    sets = saved(some.groupBy("set").agg(F.min("doc").alias("low"), F.count("*").alias("copies"), F.min(F.struct("doc", "tie")).alias("holder"), F.first("n").alias("n"), F.first("roots").alias("roots"), F.first("sample").alias("sample")), "distinct")

    def compare(rows: Iterator[tuple]) -> Iterator[tuple]:
        for _, group in groupby(rows, key=lambda r: r[:3]):
            members = [r[3:] for r in group]
            if len(members) > 1:
                yield from _candidates(members, similarity)

    links, groups, crowded, taken, splits = None, None, None, None, 0
    starts, runs = sets.select("set", F.lit(0).alias("draw"), "roots"), RUNS
    while runs:
        for run in runs:
            met, split, deep = paths(sets, starts, groups, run, similarity)
            if split is not None and taken is None:
                crowded = split if crowded is None else crowded.unionByName(split)
            splits = max(splits, deep)
            nodes = met.join(sets.select("set", "n", "sample"), "set")
            dealt = nodes.select("node", "i", "j", "set", "label", "n", "sample").repartition(parts, "node", "i", "j").sortWithinPartitions("node", "i", "j", "set")
            found = saved(map_rows(dealt, compare, "a binary, b binary").distinct(), "candidates")
            links = found if links is None else links.unionByName(found)
            groups = components(links)
        runs = ()
        if crowded is not None:
            if taken is None:
                taken = saved(_split_starts(crowded, groups).join(sets.select("set", "holder", "n", "sample", F.size("roots").alias("starts")), "set").withColumn("have", F.lit(0)), "crowded")
            due = taken.withColumn("want", more_draws(splits, similarity, F.col("n"), F.col("starts"), F.col("split")))
            due = saved(due.withColumn("want", F.greatest("want", "have")), "due")
            if due.filter("want > have").limit(1).count():
                starts, runs = saved(drawn_anew(texts, due.filter("want > have"), words), "starts"), (WHOLE,)
                taken = due.withColumn("have", F.col("want")).drop("want")
    sizes = groups.groupBy("label").agg(F.count("*").alias("m"))
    wanted = groups.join(sizes, "label").withColumnRenamed("node", "set").join(sets.select("set", "holder", "copies"), "set")
    wanted = wanted.select("label", "m", "set", "copies", F.col("holder.doc").alias("doc"), F.col("holder.tie").alias("tie"))
    held = texts.alias("t").join(wanted.alias("w"), F.col("t.doc").eqNullSafe(F.col("w.doc")) & (F.col("t.tie") == F.col("w.tie")))

    def whole(rows: Iterator[tuple]) -> Iterator[tuple]:
        seen: set[bytes] = set()
        for label, m, key, copies, data in rows:
            if key in seen:  # repeated rows; what is missed here is met again where sets are compared
                continue
            if len(seen) >= 100_000:
                seen.clear()
            seen.add(key)
            yield label, m, key, copies, token_set(data, words).tobytes()

    full = map_rows(held.select("w.label", "w.m", "w.set", "w.copies", "t.data"), whole, "label binary, m long, set binary, copies long, tokens binary", size=lambda r: len(r[4]))
    dealt = _blocks(full, "m", "set", BLOCK).select("label", "i", "j", "_own", "set", "copies", "tokens").repartition(parts, "label", "i", "j").sortWithinPartitions("label", "i", "j", "set")

    def exact(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (_, i, j), group in groupby(rows, key=lambda r: r[:3]):
            members = [next(same) for _, same in groupby((r[3:] for r in group), key=lambda r: r[1])]  # repeated rows hold a set twice
            if len(members) < 2:
                continue
            sets_ = [np.frombuffer(t, U64) for *_, t in members]
            size = np.array([len(s) for s in sets_], float)
            linked = _shared(sets_).astype(float) * (1 + similarity) >= similarity * (size[:, None] + size[None, :]) - 1e-6
            np.fill_diagonal(linked, False)
            if i != j:
                own = np.array([m[0] for m in members])
                linked &= own[:, None] != own[None, :]
            links = linked @ np.array([m[2] for m in members], float)
            for m, n, root in zip(members, links, _labels(linked), strict=True):
                if n:
                    yield m[1], members[root][1], int(n)

    linked = saved(map_rows(dealt, exact, "a binary, b binary, links long"), "linked")
    classes = components(linked.select("a", "b"))
    links = linked.groupBy(F.col("a").alias("set")).agg(F.sum("links").alias("links"))
    placed = sets.select("set", "low", "copies").join(classes.withColumnRenamed("node", "set"), "set", "left").join(links, "set", "left").withColumn("label", F.coalesce("label", "set"))
    lowest = placed.groupBy("label").agg(F.min("low").alias("class_id"))
    answer = placed.join(lowest, "label").select("set", "class_id", "label", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = rows.select("doc", "tie", "set").join(answer, "set", "left")
    return out.select(F.col("doc").alias(id), "tie", F.when(F.col("set").isNull(), F.col("doc")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("label").alias("class_key"))


def keep_one(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """df without the members of a class that aren't its first (smallest id, then hash of the text); repeated rows go too."""
    found = jaccard_join(df, id, text)
    row = F.struct(F.col(quoted(id)).alias("id"), F.col("tie").alias("tie"))
    first = found.filter("class_key is not null").groupBy("class_key").agg(F.min(row).alias("k")).select("k").union(found.filter("class_key is null").select(row.alias("k")))
    first = first.select(F.coalesce(F.concat(F.lit("="), F.col("k.id").cast("string")), F.lit("")).alias("_graphloom_id"), F.col("k.tie").alias("_graphloom_hash"))
    once = df.withColumns(row_key(id, text, "_graphloom")).dropDuplicates(["_graphloom_id", "_graphloom_hash"])
    return once.join(first, ["_graphloom_id", "_graphloom_hash"], "left_semi").select(*[F.col(quoted(c)) for c in df.columns])
