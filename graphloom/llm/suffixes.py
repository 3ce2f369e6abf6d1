"""Operator 8: remove text that repeats, by a hash-compared suffix sort.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a smaller id, or
in the same text at a smaller offset. Strings are judged on the input.

1. Anchors. In each window of LENGTH bytes the k-gram of smallest hash is its anchor, so equal
   strings have equal anchors at equal offsets. An anchor carries a hash of its k-gram and two of
   its context (all windows it can stand for), by independent bases and code tables: 96 bits.
2. Anchors meet by k-gram. Equal contexts: all but the first occurrence are covered whole; workers
   settle what repeats inside their own share before the shuffle, so a passage that a third of all
   texts hold arrives once a share. Only the first occurrences of differing contexts go on.
3. The contexts of each k-gram are suffix-sorted to the right of the anchor and, reversed, to the
   left: a mergesort whose comparisons find the common extension by bisection over prefix polynomial
   hashes; neighbours' common prefixes are verified byte by byte. Occurrences that agree on LENGTH
   bytes at an offset share a class in both orders, and all but the first are covered there.
   A k-gram with over ``GROUP`` such contexts is dealt out finer: by halves of the offsets, and in each
   by the bytes that all strings at these offsets share, until groups are small. Strings of a single
   offset that are still more are equal byte by byte; the first is found by partial aggregation.

Defined results: null text is empty; texts under LENGTH bytes keep everything; null ids come before
all others; repeated rows (same id and text) are one occurrence and get the same result; one id
with different texts is ordered by a hash of the text. Long texts are cut into overlapping segments
in memory only; no length, group or count is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, arrow_schema, as_bytes, in_batches, map_rows, mix, quoted, rows_of, saved

LENGTH, GRAM = 100, 24
REACH = LENGTH - GRAM  # an anchor starts at most so many bytes after its window
SEGMENT, HELD, CHUNK, GROUP = 1 << 20, 1_000_000, 40_000, 20_000
NULL_ID = -(2**63)

_RNG = np.random.default_rng(20)
_CODE = _RNG.integers(1, 2**63, 256, np.uint64)
_BASE = int(_RNG.integers(1, 2**62)) * 2 + 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, U64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * U64(pow(base, done, 1 << 64))
        done += step
    return out


class Hashes:
    """Prefix polynomial hashes of bytes: any substring's hash in constant time (modulo 2**64)."""

    base, code, up, down = _BASE, _CODE, np.zeros(0, U64), np.zeros(0, U64)

    def __init__(self, data: np.ndarray):
        n, kind = len(data), type(self)
        if n + 1 > len(kind.up):
            kind.up, kind.down = _powers(kind.base, max(4096, 2 * n)), _powers(pow(kind.base, -1, 1 << 64), max(4096, 2 * n))
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(kind.code[data] * kind.up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * type(self).down[start]

    def grams(self, k: int) -> np.ndarray:
        m = len(self.sums) - k
        return (self.sums[k:] - self.sums[:m]) * type(self).down[:m]


class Checks(Hashes):
    """The same by another base and code table."""

    base, code, up, down = int(_RNG.integers(1, 2**62)) * 2 + 1, _RNG.integers(1, 2**63, 256, np.uint64), np.zeros(0, U64), np.zeros(0, U64)


def _window_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum over each w consecutive values, by doubling."""
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = w - span
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(k-gram hash, context hash, 32 bits of its other hash, position) of a text's anchors."""
    n, last, found = len(data), -1, []
    for first in range(0, max(0, n - LENGTH + 1), SEGMENT):
        low, high = max(0, first - REACH), min(n, first + SEGMENT + 2 * LENGTH)
        part = data[low:high]
        hashes = Hashes(part)
        grams = mix(hashes.grams(GRAM))
        starts = first - low
        windows = min(SEGMENT, n - LENGTH + 1 - first)
        range_ = grams[starts : starts + windows + REACH]
        keyed = (range_ & U64(0xFFFFFFFF00000000)) | np.arange(len(range_), dtype=np.uint64)  # the leftmost of equal grams
        at = (np.unique(_window_minimum(keyed, REACH + 1) & U64(0xFFFFFFFF))).astype(np.int64) + starts
        at = at[at + low > last]
        if len(at):
            last = int(at[-1]) + low
            left, right = np.maximum(at - REACH, 0 if low == 0 else at - REACH), np.minimum(at + LENGTH, high - low)
            shape = (at - left).astype(np.uint64) * U64(1 << 20) + (right - at).astype(np.uint64)
            check = (mix(Checks(part).of(left, right)) >> U64(32)).astype(np.uint32).view(np.int32)
            found.append((grams[at], mix(hashes.of(left, right) ^ mix(shape)), check, at + low))
    if not found:
        return np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int32), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


_MET = "gram long, context long, check int, doc long, tie long, pos int, marks binary"
_COVER = "doc long, tie long, gram long, pos int, first boolean, marks binary"


def _met(df: DataFrame) -> DataFrame:
    """Anchors of all texts that aren't repeated inside their own share; what is, as marks of its text."""
    schema = arrow_schema(df.sparkSession.createDataFrame([], _MET).schema)

    def settle(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        gram, context, check, pos = (np.concatenate([h[i] for h in held]) for i in (2, 3, 4, 5))
        lengths = [len(h[2]) for h in held]
        number = np.repeat(np.arange(len(held)), lengths)
        doc, tie = (np.array([h[i] for h in held], np.int64) for i in (0, 1))
        order = np.lexsort((pos, tie[number], doc[number], check, context, gram))
        g, c, k, n, p = gram[order], context[order], check[order], number[order], pos[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1]) | (k[1:] != k[:-1])
        head = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        itself = (doc[n] == doc[n[head]]) & (tie[n] == tie[n[head]]) & (p == p[head])
        keep, again = fresh, ~fresh & ~itself
        columns = [g[keep].view(np.int64), c[keep].view(np.int64), k[keep], doc[n[keep]], tie[n[keep]], p[keep].astype(np.int32)]
        for i in range(0, int(keep.sum()), 50_000):
            part = [pa.array(x[i : i + 50_000]) for x in columns]
            yield pa.RecordBatch.from_arrays([*part, pa.nulls(len(part[0]), pa.binary())], schema=schema)
        if again.any():
            by = np.lexsort((p[again], n[again]))
            owner, spots = n[again][by], p[again][by].astype("<i4")
            edges = np.flatnonzero(np.diff(owner, prepend=-1))
            rows = ((None, None, None, int(doc[owner[a]]), int(tie[owner[a]]), None, spots[a:b].tobytes()) for a, b in zip(edges, [*edges[1:], len(owner)], strict=True))
            yield from in_batches(rows, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for doc, tie, data in rows_of(batches, "doc", "tie", "data"):
            found = anchors(np.frombuffer(data, np.uint8))
            if len(found[0]):
                held.append((doc, tie, *found))
                n += len(found[0])
            if n >= HELD:
                yield from settle(held)
                held, n = [], 0
        if held:
            yield from settle(held)

    return df.mapInArrow(run, _MET)


def _covers(met: DataFrame, parts: int) -> DataFrame:
    """From anchors dealt by k-gram: covered positions (first = false), first occurrences of contexts that differ (first = true), marks."""
    schema = arrow_schema(met.sparkSession.createDataFrame([], _COVER).schema)
    key = F.coalesce(F.col("gram"), F.xxhash64("doc", "tie"))
    dealt = met.repartition(parts, key).sortWithinPartitions("gram", "context", "check", "doc", "tie", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None  # the last class's first row, and whether another class of its k-gram came before
        for batch in batches:
            absent = batch.column("gram").is_null()
            marks = batch.filter(absent)
            if marks.num_rows:
                none = pa.nulls(marks.num_rows)
                yield pa.RecordBatch.from_arrays([marks.column("doc"), marks.column("tie"), none.cast(pa.int64()), none.cast(pa.int32()), pa.array(np.zeros(marks.num_rows, bool)), marks.column("marks")], schema=schema)
            batch = batch.filter(pa.compute.invert(absent))
            if not batch.num_rows:
                continue
            g, c, k, d, t, p = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            other = np.zeros(len(g), bool)
            if head is not None:
                g, c, k, d, t, p = (np.concatenate([h, x]) for h, x in zip(head[0], (g, c, k, d, t, p), strict=True))
                other = np.zeros(len(g), bool)
                other[0] = head[1]
            fresh = np.ones(len(g), bool)
            fresh[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1]) | (k[1:] != k[:-1])
            firsts = np.flatnonzero(fresh)
            at = firsts[np.cumsum(fresh) - 1]
            again = ~fresh & ((d != d[at]) | (t != t[at]) | (p != p[at]))
            same = g[firsts[1:]] == g[firsts[:-1]]
            differs = other[firsts]
            differs[1:] |= same
            before = differs.copy()
            differs[:-1] |= same
            head = [x[firsts[-1:]] for x in (g, c, k, d, t, p)], bool(before[-1])
            emit = np.concatenate([np.flatnonzero(again), firsts[:-1][differs[:-1]]])
            if len(emit):
                first = np.arange(len(emit)) >= again.sum()
                yield pa.RecordBatch.from_arrays([pa.array(d[emit]), pa.array(t[emit]), pa.array(g[emit]), pa.array(p[emit]), pa.array(first), pa.nulls(len(emit), pa.binary())], schema=schema)
        if head is not None and head[1]:
            g, _, _, d, t, p = head[0]
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(t), pa.array(g), pa.array(p), pa.array([True]), pa.nulls(1, pa.binary())], schema=schema)

    return dealt.mapInArrow(run, _COVER)


class Suffixes:
    """Strings (rows of bytes with lengths) and their prefix polynomial hashes."""

    def __init__(self, text: np.ndarray, length: np.ndarray, salt: int):
        base = U64(pow(_BASE, 2 * salt + 1, 1 << 64))
        self.text, self.length = text, length
        self.hash = np.zeros((len(text), text.shape[1] + 1), U64)
        for i in range(text.shape[1]):
            self.hash[:, i + 1] = self.hash[:, i] * base + _CODE[text[:, i]]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of rows a and b, by bisection over prefix hashes."""
        low, high = np.zeros(len(a), np.int64), np.minimum(self.length[a], self.length[b])
        while (todo := low < high).any():
            middle = (low + high + 1) // 2
            equal = self.hash[a, middle] == self.hash[b, middle]
            low, high = np.where(todo & equal, middle, low), np.where(todo & ~equal, middle - 1, high)
        return low

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether row a sorts before row b; rows that agree keep the order of their numbers."""
        n = self.common(a, b)
        ends_a, ends_b = n >= self.length[a], n >= self.length[b]
        last = self.text.shape[1] - 1
        byte_a, byte_b = self.text[a, np.minimum(n, last)], self.text[b, np.minimum(n, last)]
        return np.where(ends_a & ends_b, a < b, np.where(ends_a, True, np.where(ends_b, False, byte_a < byte_b)))

    def sorted(self, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Bottom-up mergesort inside groups: each level ranks every row in its sibling run by bisection, all rows at once.

        first, size: of each row, where its group begins and how many rows that has.
        """
        order, inside, run = np.arange(len(self.text)), np.arange(len(self.text)) - first, 1
        while (rows := np.flatnonzero(size > run)).size:
            begin, at = first[rows], inside[rows]
            mine = at // run
            start = np.where(mine % 2 == 0, mine + 1, mine - 1) * run
            low, high = begin + np.minimum(start, size[rows]), begin + np.minimum(start + run, size[rows])
            ahead = low.copy()
            while (todo := np.flatnonzero(low < high)).size:
                middle = (low[todo] + high[todo]) // 2
                less = self.before(order[middle], order[rows[todo]])
                low[todo] = np.where(less, middle + 1, low[todo])
                high[todo] = np.where(less, high[todo], middle)
            merged = order.copy()
            merged[begin + (mine // 2) * 2 * run + (at - mine * run) + (low - ahead)] = order[rows]
            order, run = merged, run * 2
        return order


def common_classes(text: np.ndarray, length: np.ndarray, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order inside each group, common prefix of each row with the one before it; -1 for a group's first), verified byte by byte.

    group: a number a row, equal ones adjacent. A base for which hashes collide is given up for the next.
    """
    group = np.zeros(len(text), np.int64) if group is None else group
    heads = np.flatnonzero(np.diff(group, prepend=group[0] - 1)) if len(group) else np.zeros(0, np.int64)
    sizes = np.diff(heads, append=len(group))
    salt = 0
    while True:
        suffixes = Suffixes(text, length, salt)
        order = suffixes.sorted(np.repeat(heads, sizes), np.repeat(sizes, sizes))
        common = np.zeros(len(order), np.int64)
        common[1:] = suffixes.common(order[:-1], order[1:])
        common[heads] = -1
        inside = np.arange(text.shape[1])[None, :] < common[1:, None]
        if not ((text[order[1:]] != text[order[:-1]]) & inside).any():
            return order, common
        salt += 1


def covered(rows: list[tuple]) -> Iterator[tuple]:
    """(doc, tie, start, end) that earlier rows of a group cover by strings that start ``least`` to ``most`` bytes before the anchor; rows are (group, doc, tie, pos, left bytes, right bytes, least, most)."""
    key = [np.array([r[i] for r in rows], np.int64) for i in range(4)]
    by = np.lexsort(key[::-1])
    rows, group, n = [rows[i] for i in by], key[0][by], len(rows)
    sides = []
    for column, width, flip in ((4, REACH, True), (5, LENGTH, False)):
        parts = [r[column][::-1] if flip else r[column] for r in rows]
        text = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(n, width)
        length = np.array([len(p) for p in parts], np.int64)
        order, common = common_classes(text, length, group)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        sides.append((length, common, place))
    (left_n, left_common, left_place), (right_n, right_common, right_place) = sides
    least, most = (np.array([r[i] for r in rows]) for i in (6, 7))
    low, high = np.full(n, REACH + 1), np.full(n, -1)
    for offset in range(REACH + 1):
        fits = np.flatnonzero((left_n >= offset) & (right_n >= LENGTH - offset) & (least <= offset) & (offset <= most))
        if len(fits) < 2:
            continue
        left = np.cumsum(left_common < offset)[left_place[fits]]
        right = np.cumsum(right_common < LENGTH - offset)[right_place[fits]]
        _, first, which = np.unique(left * (n + 1) + right, return_index=True, return_inverse=True)
        again = fits[first[which] != np.arange(len(fits))]
        low[again] = np.minimum(low[again], offset)
        high[again] = np.maximum(high[again], offset)
    for i in np.flatnonzero(high >= 0):
        _, doc, tie, pos, *_ = rows[i]
        yield doc, tie, int(pos - high[i]), int(pos - low[i] + LENGTH)


def _keyed(df: DataFrame, id: str, text: str) -> dict:
    return {"_graphloom_doc": F.coalesce(F.col(quoted(id)).cast("long"), F.lit(NULL_ID)), "_graphloom_tie": F.xxhash64(quoted(text))}


def covers_of(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """_graphloom_doc (id or NULL_ID), _graphloom_tie (hash of the text), _graphloom_covers: for each text that repeats others, what of it is covered."""
    parts = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    texts = df.withColumns(_keyed(df, id, text)).select(F.col("_graphloom_doc").alias("doc"), F.col("_graphloom_tie").alias("tie"), as_bytes(quoted(text)).alias("data"))
    covers = saved(_covers(_met(texts), parts), "covers")

    first = covers.filter("first")
    hot = saved(first.groupBy("gram").agg(F.count("*").alias("m")).filter(F.col("m") > GROUP).select("gram", F.lit(True).alias("hot")), "hot")
    some = hot.limit(1).count() > 0
    first = first.join(hot, "gram", "left") if some else first.withColumn("hot", F.lit(None).cast("boolean"))
    spots = first.groupBy("doc", "tie").agg(F.collect_list(F.struct("gram", "pos", "hot")).alias("spots"))

    def contexts(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc, tie, data, spots_ in rows:
            for s in spots_:
                pos = s["pos"]
                yield s["gram"], doc, tie, pos, data[max(0, pos - REACH) : pos], data[pos : pos + LENGTH], bool(s["hot"])

    schema = "gram long, doc long, tie long, pos int, before binary, after binary, hot boolean"
    found = map_rows(texts.dropDuplicates(["doc", "tie"]).join(spots, ["doc", "tie"]), contexts, schema, size=lambda r: 200)
    found = saved(found, "contexts") if some else found
    whole = [F.lit(0).alias("least"), F.lit(REACH).alias("most")]
    groups = found.filter("not hot").select(F.col("gram").alias("key"), "doc", "tie", "pos", "before", "after", *whole)
    equal = None
    if some:
        finer, equal = _finer(found.filter("hot").select(F.col("gram").alias("key"), "doc", "tie", "pos", "before", "after", *whole))
        groups = groups.unionByName(finer)
    dealt = groups.repartition(parts, "key").sortWithinPartitions("key")

    def compare(rows: Iterator[tuple]) -> Iterator[tuple]:
        held: list[tuple] = []
        for _, group in groupby(rows, key=lambda r: r[0]):
            held.extend(group)
            if len(held) >= CHUNK:
                yield from covered(held)
                held = []
        if held:
            yield from covered(held)

    partly = map_rows(dealt, compare, "doc long, tie long, low int, high int")
    wholly = covers.filter("not first").select("doc", "tie", (F.col("pos") - REACH).alias("low"), (F.col("pos") + LENGTH).alias("high"), "marks")
    if equal is not None:
        partly = partly.unionByName(_again(equal))
    all_ = wholly.unionByName(partly.withColumn("marks", F.lit(None).cast("binary")))
    return all_.groupBy(F.col("doc").alias("_graphloom_doc"), F.col("tie").alias("_graphloom_tie")).agg(F.collect_list(F.struct("low", "high", "marks")).alias("_graphloom_covers"))


def _finer(level: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Large groups as groups of up to GROUP rows, by offsets and the bytes that strings at these offsets share; and rows of larger groups of one offset."""
    done, equal = level.limit(0), None
    while True:
        middle = F.floor((F.col("least") + F.col("most")) / 2).cast("int")
        halves = F.array(F.struct(F.col("least").alias("a"), middle.alias("b")), F.struct((middle + 1).alias("a"), F.col("most").alias("b")))
        cut = level.withColumn("half", F.explode(halves)).withColumns({"least": F.col("half.a"), "most": F.col("half.b")}).drop("half")
        cut = cut.filter((F.length("before") >= F.col("least")) & (F.length("after") >= LENGTH - F.col("most")))
        shared = [F.expr("substring(before, length(before) - least + 1, least)"), F.expr(f"substring(after, 1, {LENGTH} - most)")]
        cut = cut.withColumn("key", F.xxhash64("least", "most", *shared))
        counted = saved(cut.join(cut.groupBy("key").agg(F.count("*").alias("m")), "key"), "finer")
        done = done.unionByName(counted.filter(F.col("m") <= GROUP).drop("m"))
        large = counted.filter(F.col("m") > GROUP).drop("m")
        single = large.filter("least = most")
        if single.limit(1).count():
            equal = single if equal is None else equal.unionByName(single)
        level = large.filter("least < most")
        if level.limit(1).count() == 0:
            return done, equal


def _again(rows: DataFrame) -> DataFrame:
    """What earlier rows cover, of rows that meet at one offset only."""
    string = F.concat(F.expr("substring(before, length(before) - least + 1, least)"), F.expr(f"substring(after, 1, {LENGTH} - least)"))
    each = rows.select("doc", "tie", (F.col("pos") - F.col("least")).alias("low"), string.alias("string"))
    place = F.struct("doc", "tie", "low")
    first = each.groupBy("string").agg(F.min(place).alias("first"))
    again = each.join(first, "string").filter(place > F.col("first"))
    return again.select("doc", "tie", "low", (F.col("low") + LENGTH).alias("high")).distinct()


def repeats(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, tie, n_bytes, n_removed, spans (start, end of removed runs), kept (the other bytes)."""

    def remove(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc, tie, data, covers in rows:
            yield (None if doc == NULL_ID else doc), tie, len(data), *cut(data, covers or [])

    texts = df.withColumns(_keyed(df, id, text)).select("_graphloom_doc", "_graphloom_tie", as_bytes(quoted(text)).alias("data"))
    out = f"{quoted(id)} long, tie long, n_bytes long, n_removed long, spans array<struct<low:int,high:int>>, kept binary"
    return map_rows(texts.join(covers_of(df, id, text), ["_graphloom_doc", "_graphloom_tie"], "left").select("_graphloom_doc", "_graphloom_tie", "data", "_graphloom_covers"), remove, out, size=lambda r: len(r[5]))


def cut(data: bytes, covers: list[dict]) -> tuple[int, list[dict], bytes]:
    """(bytes removed, maximal removed runs, what is left)."""
    if not covers:
        return 0, [], data
    low = np.array([c["low"] for c in covers if c["marks"] is None], np.int64)
    high = np.array([c["high"] for c in covers if c["marks"] is None], np.int64)
    marks = np.concatenate([np.frombuffer(c["marks"] or b"", "<i4").astype(np.int64) for c in covers])
    low, high = np.concatenate([low, marks - REACH]), np.concatenate([high, marks + LENGTH])
    edges = np.zeros(len(data) + 2, np.int64)
    np.add.at(edges, np.maximum(low, 0), 1)
    np.add.at(edges, np.minimum(high, len(data)), -1)
    gone = np.cumsum(edges[:-1]) > 0
    gone[-1] = False
    change = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0))
    spans = [{"low": int(a), "high": int(b)} for a, b in zip(change[::2], change[1::2], strict=True)]
    return int(gone.sum()), spans, np.frombuffer(data, np.uint8)[~gone[:-1]].tobytes()


def without_repeats(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """df with repeated strings cut out of the texts; texts of which nothing but white space is left go.

    Characters that a cut leaves in part are dropped.
    """
    joined = df.withColumns(_keyed(df, id, text)).join(covers_of(df, id, text), ["_graphloom_doc", "_graphloom_tie"], "left")
    schema, at = df.schema, df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            covers = batch.column(batch.num_columns - 1).to_pylist()
            texts = [old if c is None else cut(old.encode(), c)[2].decode(errors="ignore") for old, c in zip(batch.column(at).to_pylist(), covers, strict=True)]
            arrays = [batch.column(i) for i in range(batch.num_columns - 1)]
            arrays[at] = pa.array(texts, arrays[at].type)
            full = pa.array([c is None or bool(t.strip()) for c, t in zip(covers, texts, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema]).filter(full)

    return joined.select(*[F.col(quoted(c)) for c in df.columns], "_graphloom_covers").mapInArrow(run, schema)
