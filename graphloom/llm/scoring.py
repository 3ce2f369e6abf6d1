"""Operator 5: language-model scores of texts by a hierarchical Pitman-Yor model.

Tokens are words (ASCII capitals lowered) and one end a text. Each word that comes before another has
a restaurant of its own, in which its followers are seated; all these restaurants share the root as
parent, over a uniform base on the known words and one unknown. Seating is sampled by Gibbs sweeps: a
dish's tables are drawn from their conditional, given all other dishes of the restaurant and the
parent's predictive. The score averages predictive probabilities over the last sweeps.

Everything that grows with the corpus is dealt out by hash. A worker cuts its texts into chunks of
about ``Sizes.chunk`` tokens and sends each pair of words (with the texts that hold it) to the part that
has the first word's restaurant. Parts tell the root, dealt by word, how many tables each follower
has, and get the root's seating back; two such rounds are made, with local sweeps after each. Then
parts score their share of each text. Words that are first in a large share of all pairs (found on a
sample of 1 / ``Sizes.sample`` of the texts) have restaurants of several rooms, dealt by follower, whose
totals go through the root as well. All of it is one plan whose exchanges are used several times.

Within a sweep the dishes of a restaurant are drawn in two random halves, each given the other. The
parent's predictive and other rooms' totals are those of the last round. Tables of up to ``EXACT``
customers are drawn from the exact conditional; of more, from its limits.

Words are known by 64-bit keys. Defined results: null text is empty (one token, the end); null ids
count as empty text in the fold rule; repeated rows are scored one by one; without training texts
counts are 0 and every token has probability 1. Draws are keyed by part and round, so reruns agree.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache
from itertools import groupby, pairwise
from typing import NamedTuple

import numpy as np
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, as_bytes, map_rows, mix, quoted, word_hashes

CONCENTRATION = 1.0
EXACT = 256
END = xxhash.xxh64_intdigest(b"")
_ROOM = U64(0xD6E8FEB86659FD93)


def token_keys(data: bytes) -> np.ndarray:
    return np.append(word_hashes(data.lower().split()), U64(END))


def part_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Number of the hash range of each (mixed) key."""
    return (((keys >> U64(40)) * U64(n)) >> U64(24)).astype(np.int64)


@cache
def slots(n: int) -> np.ndarray:
    """A number for each of n parts that Spark's hash puts in a partition of its own, of n."""
    out, first = np.full(n, -1, np.int64), 0
    while (out < 0).any():
        x = np.arange(first, first + 4 * n + 64, dtype=np.uint32)
        rolled = lambda v, r: (v << np.uint32(r)) | (v >> np.uint32(32 - r))
        h = rolled(np.uint32(42) ^ rolled(x * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593), 13) * np.uint32(5) + np.uint32(0xE6546B64) ^ np.uint32(4)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        at, found = np.unique((h ^ (h >> np.uint32(16))).view(np.int32).astype(np.int64) % n, return_index=True)
        fresh = out[at] < 0
        out[at[fresh]] = first + found[fresh]
        first += len(x)
    return out


def pack(x: np.ndarray) -> bytes:
    """Numbers from 0 in the narrowest of four widths, which the first byte tells."""
    top = int(x.max()) if len(x) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w or w == 8)
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


# seating --------------------------------------------------------------------------------------


class Sizes(NamedTuple):
    """How much a worker holds at once, and how long the chains are."""

    chunk: int = 2_000_000  # tokens of a chunk
    pairs: int = 2_000_000  # of a part, about
    sample: int = 64  # frequent first words are found on one text in so many
    settle: int = 2  # sweeps of the first round
    sweeps: int = 4  # of the second, and of the root in each
    burn_in: int = 1  # sweeps of the second round that aren't averaged
    exact: int = EXACT


@cache
def _stirling(discount: float) -> np.ndarray:
    """log of the generalised Stirling numbers: row n, column t has the weight of all ways to seat n customers at t tables."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(1, EXACT + 1)
    for n in range(2, EXACT + 1):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = np.where(t < n, np.log(np.maximum(n - 1 - discount * t, 1e-300)) + out[n - 1, 1:], -np.inf)
        out[n, 1:] = np.logaddexp(out[n - 1, :-1], stay)
    return out


def draw_tables(n: int, others: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with n customers each; others: tables of their restaurants' other dishes, weight: the parent's probability."""
    out, logs, step = np.empty(len(others)), _stirling(discount)[n, 1 : n + 1], max(1, (1 << 18) // n)
    for i in range(0, len(others), step):
        w = np.log((CONCENTRATION + discount * (others[i : i + step, None] + np.arange(n))) * weight[i : i + step, None])
        np.cumsum(w, axis=1, out=w)
        w += logs
        w -= w.max(1, keepdims=True)
        np.exp(w, out=w)
        np.cumsum(w, axis=1, out=w)
        out[i : i + step] = 1 + (w < rng.random(len(w))[:, None] * w[:, -1:]).sum(1)
    return np.minimum(out, n)


def draw_many_tables(n: np.ndarray, others: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """The same for many customers, by the limits of the conditional: normal at the mode, or negative binomial where tables are few.

    The Stirling numbers are coefficients of powers of f(z) = (1 - (1 - z)^d) / d; at their saddle
    point z = 1 - exp(-y), t tables go with n customers if t z f'(z) = n f(z).
    """
    a, d = others + CONCENTRATION / discount, discount

    def at(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        f = -np.expm1(-d * y) / d
        t = n * f * np.exp(-y * (1 - d)) / -np.expm1(-y)
        return t, np.log(f) + np.log(d * weight) + np.log((a + t - 0.5) / (t + 0.5))

    low, high = np.full(len(n), math.log(1e-9)), np.full(len(n), math.log(600.0))
    for _ in range(60):
        middle = (low + high) / 2
        up = at(np.exp(middle))[1] < 0
        low, high = np.where(up, middle, low), np.where(up, high, middle)
    y = np.exp((low + high) / 2)
    t, _ = at(y)
    (t0, g0), (t1, g1) = at(y * 0.999), at(y * 1.001)
    spread = np.sqrt(np.maximum((t0 - t1) / np.maximum(g1 - g0, 1e-9), 0))
    curve = lambda y: np.log(1 - d + 1 / np.expm1(y) - d / np.expm1(d * y)) + np.log(np.expm1(y))
    slope = (curve(y * 1.001) - curve(y * 0.999)) / np.minimum(t1 - t0, -1e-300)  # of the saddle point's width, which moves the mode
    mean = t + 0.5 - np.clip(spread**2 * slope / 2, -t, t)
    out = np.rint(mean + spread * rng.normal(size=len(n)))
    few = (a + 1) * weight < 0.2 * (1 - weight) * n**d
    out[few] = 1 + rng.negative_binomial((a + 1)[few], (1 - weight)[few])
    return np.clip(out, 1, n)


class Seating:
    """Tables of dishes (restaurant ``place``, ``n`` customers); beyond: tables of the same restaurants that are seated elsewhere."""

    def __init__(self, place: np.ndarray, n: np.ndarray, beyond: np.ndarray, discount: float, rng: np.random.Generator, exact: int = EXACT):
        self.place, self.n, self.beyond, self.discount, self.rng = place, n, beyond, discount, rng
        self.tables = (n > 0).astype(float)
        order = np.argsort(n, kind="stable")
        order = order[np.searchsorted(n[order], 2) :]
        self.large = order[np.searchsorted(n[order], exact + 1) :]
        order = order[: len(order) - len(self.large)]
        edges = np.flatnonzero(np.diff(n[order], prepend=0))
        self.groups = [(int(n[order[i]]), order[i:j]) for i, j in pairwise([*edges, len(order)])]

    def totals(self) -> np.ndarray:
        return np.bincount(self.place, self.tables, len(self.beyond)) + self.beyond

    def sweep(self, weight: np.ndarray) -> None:
        """Each dish anew, a random half of them first; weight: the parent's probability of each dish."""
        half = self.rng.random(len(self.n)) < 0.5
        for now in (half, ~half):
            total = self.totals()
            for n, rows in self.groups:
                some = rows[now[rows]]
                if len(some):
                    self.tables[some] = draw_tables(n, total[self.place[some]] - self.tables[some], weight[some], self.discount, self.rng)
            some = self.large[now[self.large]]
            if len(some):
                self.tables[some] = draw_many_tables(self.n[some].astype(float), total[self.place[some]] - self.tables[some], weight[some], self.discount, self.rng)

    def averaged(self, weight: np.ndarray, sweeps: int, burn_in: int) -> np.ndarray:
        """Mean tables over the sweeps after ``burn_in``; predictive probabilities are linear in them."""
        out = np.zeros(len(self.n))
        for i in range(sweeps):
            self.sweep(weight)
            if i >= burn_in:
                out += self.tables
        return out / (sweeps - burn_in)


def discount_of(ones: float, twos: float) -> float:
    return round(ones / (ones + 2 * twos), 6) if ones and twos else 0.5


def root_predictive(guests: np.ndarray, tables: np.ndarray, all_guests: float, all_tables: float, words: float, discount: float) -> np.ndarray:
    base = 1 / (words + 1)
    return (guests - discount * tables + (CONCENTRATION + discount * all_tables) * base) / (CONCENTRATION + all_guests)


# texts to parts -------------------------------------------------------------------------------


def pairs(texts: list[np.ndarray], learns: list[bool], parts: int, hot: np.ndarray, rooms: np.ndarray) -> Iterator[tuple]:
    """(part, words, contexts, follows, places, times): the pairs of words of some texts, by the part of the first word.

    contexts: distinct first words and how many entries each has; an entry is a second word, the number
    of a text, and how often the pair stands there (doubled, plus 1 if the text is learned from).
    """
    tokens, lengths = np.concatenate(texts), np.array([len(t) for t in texts])
    words, second = np.unique(tokens, return_inverse=True)
    first = np.empty_like(second)
    first[1:] = second[:-1]
    first[np.cumsum(lengths) - lengths] = np.searchsorted(words, U64(END))
    doc, spread = np.repeat(np.arange(len(texts)), lengths), mix(words)
    part = part_of(spread, parts)[first]
    if len(hot):
        at = np.minimum(np.searchsorted(hot, words), len(hot) - 1)
        several = np.where(hot[at] == words, rooms[at], 1)[first]
        shared = np.flatnonzero(several > 1)
        room = (spread[second[shared]] >> U64(7)) % several[shared].astype(np.uint64)
        part[shared] = part_of(mix(spread[first[shared]] + room * _ROOM), parts)
    w = len(words)
    order = np.argsort((part * w + first) * w + second, kind="stable") if parts * w * w < 1 << 62 else np.lexsort((second, first, part))
    part, first, second, doc = part[order], first[order], second[order], doc[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (part[1:] != part[:-1]) | (first[1:] != first[:-1]) | (second[1:] != second[:-1]) | (doc[1:] != doc[:-1])
    entry = np.flatnonzero(fresh)
    times = np.diff(entry, append=len(doc)) * 2 + np.array(learns, np.int64)[doc[entry]]
    part, first, second, doc = part[entry], first[entry], second[entry], doc[entry]
    edges = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in pairwise([*edges, len(part)]):
        own, at = np.unique(np.concatenate([first[a:b], second[a:b]]), return_inverse=True)
        heads = np.flatnonzero(np.diff(first[a:b], prepend=-1))
        yield int(part[a]), words[own].tobytes(), pack(np.stack([at[heads], np.diff(heads, append=b - a)]).ravel()), pack(at[b - a :]), pack(doc[a:b]), pack(times[a:b])


class Entries:
    """One row of :func:`pairs`, read back."""

    def __init__(self, words: bytes, contexts: bytes, follows: bytes, places: bytes, times: bytes):
        self.words = np.frombuffer(words, U64)
        heads, n = unpack(contexts).reshape(2, -1)
        self.first, self.second, self.doc, times_ = np.repeat(heads, n), unpack(follows), unpack(places), unpack(times)
        self.times, self.learned = times_ >> 1, (times_ >> 1) * (times_ & 1)
        cell = np.ones(len(self.first), bool)
        cell[1:] = (self.first[1:] != self.first[:-1]) | (self.second[1:] != self.second[:-1])
        self.heads, self.cell = np.flatnonzero(cell), np.cumsum(cell) - 1


class Part:
    """The restaurants of one part: distinct pairs of words with their counts in texts that are learned from."""

    def __init__(self, rows: Iterator[tuple], merge: int):
        held: list[tuple] = []
        volume, self.keys, self.code, self.n = 0, np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for r in rows:
            e = Entries(*r)
            held.append((e.words, e.first[e.heads], e.second[e.heads], np.add.reduceat(e.learned, e.heads)))
            volume += len(e.heads)
            if volume >= merge:
                self._merge(held)
                held, volume = [], 0
        self._merge(held)
        self.first, self.second = self.code // len(self.keys) if len(self.keys) else self.code, self.code % max(len(self.keys), 1)
        self.follows = np.unique(self.second)  # numbers of words that come second

    def _merge(self, held: list[tuple]) -> None:
        if not held:
            return
        before, keys = max(len(self.keys), 1), np.unique(np.concatenate([self.keys, *(h[0] for h in held)]))
        old = np.searchsorted(keys, self.keys)
        code, n = [old[self.code // before] * len(keys) + old[self.code % before]] if len(self.code) else [], [self.n] if len(self.code) else []
        for words, first, second, learned in held:
            at = np.searchsorted(keys, words)
            code.append(at[first] * len(keys) + at[second])
            n.append(learned)
        self.keys = keys
        self.code, inverse = np.unique(np.concatenate(code), return_inverse=True)
        self.n = np.bincount(inverse, np.concatenate(n), len(self.code)).astype(np.int64)

    def by_root(self, roots: int) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the followers in the order of root parts and keys, where each root part begins)."""
        root = part_of(mix(self.keys[self.follows] ^ _ROOM), roots)
        order = np.argsort(root, kind="stable")
        return self.follows[order], np.searchsorted(root[order], np.arange(roots + 1))

    def shared(self, hot: np.ndarray, roots: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for the first words that have rooms in other parts."""
        at = np.flatnonzero(np.isin(self.keys, hot)) if len(hot) else np.zeros(0, np.int64)
        at = at[np.isin(at, self.first)]
        root = part_of(mix(self.keys[at] ^ _ROOM), roots)
        order = np.argsort(root, kind="stable")
        return at[order], np.searchsorted(root[order], np.arange(roots + 1))

    def tables_by_word(self, tables: np.ndarray) -> np.ndarray:
        return np.bincount(self.second, tables, len(self.keys))


# messages: what parts and root parts send each other, as rows of one schema ------------------------

_COLUMNS = ("to", "kind", "source", "a", "b", "c", "d", "e")
_MESSAGE = "to int, kind int, source long, a binary, b binary, c binary, d binary, e binary"
PAIRS, TOTALS, FIRST, SECOND, DOCS = range(5)
_wide = lambda r: sum(len(x) for x in r if isinstance(x, bytes))


def _sum(df: DataFrame, read, n: int) -> DataFrame:
    """One row of n totals: what ``read`` makes of each partition's messages."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        total = np.zeros(n)
        for x in read(rows):
            total += x
        yield (total.tolist(),)

    return map_rows(df, run, "x array<double>").agg(F.array(*[F.coalesce(F.sum(F.get("x", F.lit(i))), F.lit(0.0)) for i in range(n)]).alias("x"))


def _told(totals: DataFrame, source: int, to: int) -> DataFrame:
    """A row of totals as a message to each of ``to`` parts."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (x,) in rows:
            yield from ((int(i), TOTALS, source, np.array(x).tobytes(), b"", b"", b"", b"") for i in slots(to))

    return map_rows(totals, run, _MESSAGE)


class _Root:
    """Words of one root part, as the first and second round's messages tell."""

    def __init__(self, group: Iterator[tuple]):
        self.totals, self.asked, self.second = {}, {}, {}
        for _, kind, source, a, b, c, d, e in group:
            if kind == TOTALS:
                self.totals[source] = np.frombuffer(a)
            elif kind == FIRST:
                self.asked[source] = (np.frombuffer(a, U64), unpack(b), unpack(c), np.frombuffer(d, U64), unpack(e).reshape(2, -1))
            else:
                self.second[source] = (unpack(a), unpack(b))
        empty = np.zeros(0, U64)
        self.keys, self.at = np.unique(np.concatenate([empty, *(x[0] for x in self.asked.values())]), return_inverse=True)
        self.firsts, self.first_at = np.unique(np.concatenate([empty, *(x[3] for x in self.asked.values())]), return_inverse=True)
        guests = [x[1] for x in self.asked.values()] if not self.second else [self.second[s][0] for s in self.asked]
        self.guests = self._summed(self.at, guests, len(self.keys))
        self.counts = self._summed(self.at, [x[2] for x in self.asked.values()], len(self.keys))
        tables = [x[4][1] for x in self.asked.values()] if not self.second else [self.second[s][1] for s in self.asked]
        self.seated = self._summed(self.first_at, [x[4][0] for x in self.asked.values()], len(self.firsts))
        self.shared = self._summed(self.first_at, tables, len(self.firsts))

    @staticmethod
    def _summed(at: np.ndarray, values: list[np.ndarray], n: int) -> np.ndarray:
        return np.bincount(at, np.concatenate(values), n).astype(np.int64) if n else np.zeros(0, np.int64)

    def seat(self, to: int, kind: int, sizes: Sizes) -> np.ndarray:
        """Tables of each word in the root: of the last sweep, or in the second round the mean."""
        words, _, _, ones, twos, *_ = self.totals[0]
        known = words if kind == FIRST else self.totals[1][0]
        seating = Seating(np.zeros(len(self.guests), np.int64), self.guests, np.array([max(0.0, known - (self.guests > 0).sum())]), discount_of(ones, twos), np.random.default_rng((to, kind)), sizes.exact)
        weight = np.full(len(self.guests), 1 / (words + 1))
        return seating.averaged(weight, sizes.sweeps, sizes.sweeps - 1 if kind == FIRST else sizes.burn_in)

    def answers(self, tables: np.ndarray, kind: int) -> Iterator[tuple]:
        """(part, guests, tables, counts, customers, tables) to each part that asked: guests and tables of its words, their counts, customers and tables of its first words with rooms elsewhere."""
        i = j = 0
        for part, (keys, _, _, firsts, _) in self.asked.items():
            at, rooms = self.at[i : i + len(keys)], self.first_at[j : j + len(firsts)]
            i, j = i + len(keys), j + len(firsts)
            yield part, pack(self.guests[at]), tables[at].astype("<f4").tobytes(), pack(self.counts[at]) if kind == FIRST else b"", pack(self.seated[rooms]), pack(self.shared[rooms])


class _Told:
    """What a part was told: totals, then per round the root's view of its followers, in the order it asked for."""

    def __init__(self):
        self.totals: dict[int, np.ndarray] = {}
        self.rounds: dict[int, dict[int, tuple]] = {FIRST: {}, SECOND: {}}

    def add(self, kind: int, source: int, a: bytes, b: bytes, c: bytes, d: bytes, e: bytes) -> None:
        if kind == TOTALS:
            self.totals[source] = np.frombuffer(a)
        else:
            self.rounds[kind][source] = (unpack(a), np.frombuffer(b, "<f4"), unpack(c) if c else np.zeros(0, np.int64), unpack(d), unpack(e))

    def joined(self, round_: int, column: int) -> np.ndarray:
        kept = [x[column] for _, x in sorted(self.rounds[round_].items())]
        return np.concatenate(kept).astype(float) if kept else np.zeros(0)


class _Model:
    """A part's restaurants, seated by what the root has told."""

    def __init__(self, to: int, part: Part, told: _Told, hot: np.ndarray, roots: int, sizes: Sizes):
        self.part, self.told, self.sizes = part, told, sizes
        self.words, self.tokens, self.cells, self.ones, self.twos, c1, c2 = told.totals[0]
        self.discount, self.root_discount = discount_of(c1, c2), discount_of(self.ones, self.twos)
        self.order, _ = part.by_root(roots)
        self.rooms, _ = part.shared(hot, roots)
        width = len(part.keys)
        self.own = np.bincount(part.first, part.n, width)
        self.customers = self.own.copy()
        self.customers[self.rooms] = told.joined(FIRST, 3)
        self.seating = Seating(part.first, part.n, np.zeros(width), self.discount, np.random.default_rng((to, 0)), sizes.exact)
        self._beyond(FIRST)
        weight = self.parent(FIRST)[part.second]
        for _ in range(sizes.settle):
            self.seating.sweep(weight)

    def _beyond(self, round_: int) -> None:
        """Tables of the same restaurants' rooms in other parts, as of the round."""
        here = np.bincount(self.part.first, self.seating.tables, len(self.part.keys))[self.rooms]
        self.seating.beyond[self.rooms] = np.maximum(self.told.joined(round_, 4) - here, 0)

    def parent(self, round_: int) -> np.ndarray:
        """The root's predictive probability of each word of the part that comes second."""
        guests, tables = self.told.joined(round_, 0), self.told.joined(round_, 1)
        all_guests, all_tables = (self.cells, self.told.totals[1][0]) if round_ == FIRST else (self.told.totals[2][0], self.told.totals[2][1])
        out = np.zeros(len(self.part.keys))
        out[self.order] = root_predictive(guests, tables, all_guests, all_tables, self.words, self.root_discount)
        return out

    def predictive(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probability of each pair without the parent's share, that share by first word, the parent by second word)."""
        self._beyond(SECOND)
        parent = self.parent(SECOND)
        tables = self.seating.averaged(parent[self.part.second], self.sizes.sweeps, self.sizes.burn_in)
        total = np.bincount(self.part.first, tables, len(self.part.keys)) + self.seating.beyond
        down = CONCENTRATION + self.customers
        return np.maximum(self.part.n - self.discount * tables, 0) / down[self.part.first], (CONCENTRATION + self.discount * total) / down, parent


# the operator ---------------------------------------------------------------------------------


def hot_words(rows: DataFrame, tokens: int, sizes: Sizes) -> tuple[np.ndarray, np.ndarray]:
    """(keys, rooms) of words that come first in so many pairs that one part should not hold them all; the 100,000 most frequent at most."""
    if tokens <= sizes.pairs:
        return np.zeros(0, U64), np.zeros(0, np.int64)

    def count(rows: Iterator[tuple]) -> Iterator[tuple]:
        seen: Counter = Counter()
        for (data,) in rows:
            keys, n = np.unique(token_keys(data), return_counts=True)
            seen.update(dict(zip(keys.view(np.int64).tolist(), n.tolist(), strict=True)))
            if len(seen) > 500_000:
                yield from seen.items()
                seen.clear()
        yield from seen.items()

    sample = rows.filter(F.pmod(F.xxhash64("data", "row"), F.lit(sizes.sample)) == 0).select("data")
    found = map_rows(sample, count, "key long, n long").groupBy("key").agg((F.sum("n") * sizes.sample).alias("n")).filter(F.col("n") * 4 >= sizes.pairs)
    found = sorted((np.int64(r["key"]).view(np.uint64), -(-4 * r["n"] // sizes.pairs)) for r in found.orderBy(F.desc("n"), "key").limit(100_000).collect())
    return np.array([k for k, _ in found], U64), np.array([n for _, n in found], np.int64)


def score(df: DataFrame, learns: Column, id: str = "doc_id", text: str = "text", sizes: Sizes = Sizes()) -> DataFrame:
    """One row per input row: id, n_tokens, n_known, train_tokens, base_score, score, perplexity. The model learns from rows under ``learns``."""
    rows = df.select(F.col(quoted(id)).alias("doc"), as_bytes(quoted(text)).alias("data"), F.coalesce(learns, F.lit(False)).alias("learns"), F.monotonically_increasing_id().alias("row"))
    kind = rows.schema["doc"].dataType.simpleString()
    size = df.agg(F.sum(F.octet_length(quoted(text))).alias("n"), F.count("*").alias("rows")).first()
    tokens = (size["n"] or 0) // 6 + size["rows"]
    parts = max(4, -(-tokens // sizes.pairs))
    spread = parts
    hot, rooms = hot_words(rows, tokens, sizes)
    shared = df.sparkSession.sparkContext.broadcast((hot, rooms))  # at most 100,000 words
    columns = f"{_MESSAGE}, ids array<{kind}>"

    def together(union: DataFrame) -> DataFrame:
        """Children of a union that are partitioned alike stay where they are, unless that is switched off."""
        alike = df.sparkSession.conf.get("spark.sql.unionOutputPartitioning") == "true"
        return union if alike else union.repartition(spread, "to")

    def deal(rows: Iterator[tuple]) -> Iterator[tuple]:
        hot, rooms = shared.value
        chunk, texts, learned, ids, n = TaskContext.get().partitionId() << 32, [], [], [], 0

        def sent() -> Iterator[tuple]:
            yield int(slots(parts)[int(mix(np.array([chunk], U64))[0]) % parts]), DOCS, chunk, pack(np.array([len(t) for t in texts])), b"", b"", b"", b"", ids
            for part, *entries in pairs(texts, learned, parts, hot, rooms):
                yield int(slots(parts)[part]), PAIRS, chunk, *entries, None

        for doc, data, learn in rows:
            texts.append(token_keys(data))
            learned.append(learn)
            ids.append(doc)
            n += len(texts[-1])
            if n >= sizes.chunk:
                yield from sent()
                chunk, texts, learned, ids, n = chunk + 1, [], [], [], 0
        if texts:
            yield from sent()

    dealt = map_rows(rows.select("doc", "data", "learns"), deal, columns, _wide).repartition(spread, "to")

    def ask(rows: Iterator[tuple]) -> Iterator[tuple]:
        for to, group in groupby(rows, key=lambda r: r[0]):
            part = Part((r[3:8] for r in group if r[1] == PAIRS), sizes.pairs // 2)
            if not len(part.keys):
                continue
            known, counts = part.tables_by_word(part.n > 0).astype(np.int64), part.tables_by_word(part.n).astype(np.int64)
            seated, tables = (np.bincount(part.first, x, len(part.keys)).astype(np.int64) for x in (part.n, part.n > 0))
            (order, edge), (rooms, ends) = part.by_root(parts), part.shared(shared.value[0], parts)
            for root in range(parts):
                some, firsts = order[edge[root] : edge[root + 1]], rooms[ends[root] : ends[root + 1]]
                if len(some) or len(firsts):
                    yield int(slots(parts)[root]), FIRST, to, part.keys[some].tobytes(), pack(known[some]), pack(counts[some]), part.keys[firsts].tobytes(), pack(np.concatenate([seated[firsts], tables[firsts]]))
            yield int(slots(parts)[0]), TOTALS, -1 - to, np.array([(part.n == 1).sum(), (part.n == 2).sum()], float).tobytes(), b"", b"", b"", b""

    asked = map_rows(dealt.sortWithinPartitions("to"), ask, _MESSAGE, _wide).repartition(spread, "to")

    def merged(rows: Iterator[tuple]) -> Iterator[list]:
        for _, group in groupby(rows, key=lambda r: r[0]):
            held = list(group)
            for r in held:
                if r[1] == TOTALS:
                    yield np.concatenate([np.zeros(5), np.frombuffer(r[3])])
            root = _Root(r for r in held if r[1] == FIRST)
            yield np.array([(root.counts > 0).sum(), root.counts.sum(), root.guests.sum(), (root.guests == 1).sum(), (root.guests == 2).sum(), 0, 0], float)

    known = _told(_sum(asked.sortWithinPartitions("to"), merged, 7), 0, parts)
    known_to = known.repartition(spread, "to")

    def seat(kind: int) -> Callable[[Iterator[tuple]], Iterator[tuple]]:
        def run(rows: Iterator[tuple]) -> Iterator[tuple]:
            number = {int(x): i for i, x in enumerate(slots(parts))}
            for slot, group in groupby(rows, key=lambda r: r[0]):
                to = number[slot]
                root = _Root(r for r in group if r[1] != TOTALS or r[2] >= 0)
                tables = root.seat(to, kind, sizes)
                for part, *x in root.answers(tables, kind):
                    yield part, kind, to, *x
                yield -1, TOTALS, to, np.array([tables.sum(), root.guests.sum()]).tobytes(), b"", b"", b"", b""

        return run

    def summed(rows: Iterator[tuple]) -> Iterator[np.ndarray]:
        return (np.frombuffer(r[3]) for r in rows if r[1] == TOTALS and r[0] < 0)

    def with_pairs(*told: DataFrame, twice: bool) -> DataFrame:
        """Messages and the dealt pairs, which stand last, and once more if they are scored too; all are partitioned alike, so nothing moves."""
        out = dealt.withColumn("step", F.lit(1))
        for step, other in [*((2, d) for d in [dealt] * twice), *((0, d.withColumn("ids", F.lit(None).cast(f"array<{kind}>"))) for d in told)]:
            out = out.unionByName(other.withColumn("step", F.lit(step)))
        return together(out.select("to", "step", "kind", "source", "a", "b", "c", "d", "e", "ids")).sortWithinPartitions("to", "step", "source")

    def modelled(to: int, group: Iterator[tuple]) -> tuple[_Model | None, Iterator]:
        """The part's model, and its rows of the last step."""
        told, steps = _Told(), groupby(group, key=lambda r: r[1])
        for step, some in steps:
            if step == 0:
                for r in some:
                    told.add(*r[2:9])
            elif step == 1:
                part = Part((r[4:9] for r in some if r[2] == PAIRS), sizes.pairs // 2)
                model = _Model(to, part, told, shared.value[0], parts, sizes) if len(part.keys) else None
                rest = next(steps, (2, iter(())))[1]
                return model, rest
        return None, iter(())

    def sweep(rows: Iterator[tuple]) -> Iterator[tuple]:
        for to, group in groupby(rows, key=lambda r: r[0]):
            model, _ = modelled(to, group)
            if model is None:
                continue
            tables, seats = model.part.tables_by_word(model.seating.tables).astype(np.int64), np.bincount(model.part.first, model.seating.tables, len(model.part.keys)).astype(np.int64)
            (order, edge), (rooms, ends) = model.part.by_root(parts), model.part.shared(shared.value[0], parts)
            for root in range(parts):
                some, firsts = order[edge[root] : edge[root + 1]], rooms[ends[root] : ends[root + 1]]
                if len(some) or len(firsts):
                    yield int(slots(parts)[root]), SECOND, to, pack(tables[some]), pack(seats[firsts]), b"", b"", b""

    by_root = ("to", "kind", "source")
    first = map_rows(together(known_to.unionByName(asked).select(*_COLUMNS)).sortWithinPartitions(*by_root), seat(FIRST), _MESSAGE, _wide).repartition(spread, "to")
    told = [known_to, first, _told(_sum(first.sortWithinPartitions("to"), summed, 2), 1, parts).repartition(spread, "to")]
    swept = map_rows(with_pairs(*told, twice=False), sweep, _MESSAGE, _wide).repartition(spread, "to")
    second = map_rows(together(told[2].unionByName(known_to).unionByName(asked).unionByName(swept).select(*_COLUMNS)).sortWithinPartitions(*by_root), seat(SECOND), _MESSAGE, _wide).repartition(spread, "to")
    told += [second, _told(_sum(second.sortWithinPartitions("to"), _second_totals, 2), 2, parts).repartition(spread, "to")]

    def judge(rows: Iterator[tuple]) -> Iterator[tuple]:
        for to, group in groupby(rows, key=lambda r: r[0]):
            model, rest = modelled(to, group)
            if model is not None:
                part, (own, share, parent) = model.part, model.predictive()
                counts = np.zeros(len(part.keys))
                counts[model.order] = model.told.joined(FIRST, 2)
                log_count = np.log10(counts + 1)
            for r in rest:
                if r[2] == DOCS:
                    yield r[3], -1, r[4], b"", b"", 0.0, 0.0, r[9]
                    continue
                e = Entries(*r[4:9])
                at = np.searchsorted(part.keys, e.words)
                f, s = at[e.first[e.heads]], at[e.second[e.heads]]
                p = np.log10(own[np.searchsorted(part.code, f * len(part.keys) + s)] + share[f] * parent[s])
                n = int(e.doc.max()) + 1
                base, seen = log_count[s], counts[s] > 0
                sums = [np.bincount(e.doc, e.times * x[e.cell], n) for x in (p, base, seen)]
                yield r[3], to, pack(sums[2].astype(np.int64)), sums[0].tobytes(), sums[1].tobytes(), model.tokens, model.words, None

    out = f"chunk long, part int, a binary, b binary, c binary, tokens double, words double, ids array<{kind}>"
    judged = map_rows(with_pairs(*told, twice=True), judge, out, _wide).repartition(spread, "chunk").sortWithinPartitions("chunk", "part")

    def close(rows: Iterator[tuple]) -> Iterator[tuple]:
        for _, group in groupby(rows, key=lambda r: r[0]):
            _, _, a, *_, ids = next(group)
            length = unpack(a)
            known, (p, base) = np.zeros(len(ids), np.int64), np.zeros((2, len(ids)))
            tokens = words = 0.0
            for _, _, a, b, c, tokens, words, _ in group:
                n = len(b) // 8
                known[:n] += unpack(a)
                p[:n] += np.frombuffer(b)
                base[:n] += np.frombuffer(c)
            base -= length * math.log10(tokens + words + 1)
            for i, doc in enumerate(ids):
                yield doc, int(length[i]), int(known[i]), int(tokens), float(base[i]), float(p[i]), float(10 ** (-p[i] / length[i]))

    return map_rows(judged, close, f"{quoted(id)} {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def _second_totals(rows: Iterator[tuple]) -> Iterator[np.ndarray]:
    """(guests, tables) of all words after the second round."""
    return (np.frombuffer(r[3])[::-1] for r in rows if r[1] == TOTALS and r[0] < 0)


def in_fold(id: Column, folds: int = 7, fold: int = 2) -> Column:
    """crc32 of the id as text modulo ``folds`` is ``fold``; a null id counts as empty text."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % folds == fold
