import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from graphloom.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, _v string, _length string"


def by_hand(rows, parts=8, entries=16, rounds=6):
    """vec_id, label, vector -> sorted (vec_id, code, error, label_error, sha) by exhaustive search on Python integers."""
    kept = [(i, v, g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    by_length = defaultdict(list)
    for i, v, g in kept:
        ints = [math.floor(4096 * float(np.float32(x))) for x in v]
        ints += [0] * (-len(ints) % parts)
        by_length[len(ints)].append((i, ints, g))
    out = []
    for length, some in by_length.items():
        width = length // parts
        cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]  # noqa: E731, B023
        first = sorted(some, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
        books = [[cut(v)[p] for _, v, _ in first] for p in range(parts)]

        def nearest(part, book):
            return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

        for _ in range(rounds if length else 0):
            for p in range(parts):
                sums = defaultdict(list)
                for _, v, _ in some:
                    sums[nearest(cut(v)[p], books[p])[1]].append(cut(v)[p])
                for k, members in sums.items():
                    books[p][k] = [sum(xs) // len(members) for xs in zip(*members)]
        text = ",".join(str(x) for book in books for e in book for x in e) if length else ""
        sha = hashlib.sha256(text.encode()).hexdigest()
        for i, v, g in some:
            near = [nearest(part, books[p]) for p, part in enumerate(cut(v))] if length else [(0, 0)] * parts
            out.append((i, "".join(f"{k:02x}" for _, k in near), sum(d for d, _ in near), g, sha))
    total = defaultdict(int)
    for _, _, e, g, _ in out:
        total[g] += e
    return sorted([(i, c, e, total[g], s) for i, c, e, g, s in out], key=str)


def got(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, g, "x", "x", "x") for i, v, g in rows], SCHEMA).repartition(3)
    return sorted([tuple(r) for r in codes.compress(df, **kw).collect()], key=str)


def random_rows(seed, n, length=16, grid=None):
    rng = random.Random(seed)
    value = (lambda: rng.gauss(0, 1)) if grid is None else (lambda: rng.randrange(grid) / 4096)
    return [(i * 3 % n, [value() for _ in range(length)], rng.choice([0, 1, 2, None])) for i in range(n)]


@pytest.mark.parametrize("grid", [None, 3])
def test_as_by_hand(spark, grid):
    """On a grid of three values most parts are tied between entries, many of which are equal."""
    rows = random_rows(1, 120, grid=grid)
    assert got(spark, rows) == by_hand(rows)


def test_odd_vectors(spark):
    rows = random_rows(2, 40)
    rows += [(100, None, 1), (101, [1.0] * 15 + [None], 1), (102, [float("nan")] * 16, 1), (103, [float("inf")] * 16, None), (104, [0.0] * 16, None), (None, [1.0] * 16, 2), (5, [2.0] * 16, 0), (5, [2.0] * 16, 0)]
    rows += [(200 + i, [float(i), 1.0, -2.0], 7) for i in range(4)] + [(300, [], 8)]
    assert got(spark, rows) == by_hand(rows)


def test_no_rows(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None, 1)]) == []


def test_huge_components_are_cut_off(spark):
    rows = [(i, [3e38 if i % 2 else -3e38] * 16, 1) for i in range(20)]
    found = got(spark, rows)
    assert len(found) == 20 and all(r[2] == 0 for r in found)


def test_nearest_equals_exhaustive_search():
    rng = np.random.default_rng(5)
    for scale in (2, 50, 100_000):
        book = rng.integers(-scale, scale, (16, 4))
        queries = rng.integers(-scale, scale, (500, 4))
        place, best = codes.nearest(queries, book)
        d = ((queries[:, None] - book[None]) ** 2).sum(2)
        assert (place == d.argmin(1)).all() and (best == d.min(1)).all()


def test_annulus_leaves_entries_out(monkeypatch):
    """Entries of very different norms aren't evaluated."""
    met = []
    book = np.array([[10**k, 0] for k in range(8)], np.int64)

    class Counting(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, np.ndarray) and at.ndim == 1 and self.ndim == 2:
                met.append(len(at))
            return np.asarray(super().__getitem__(at)) if len(met) > 1 else super().__getitem__(at)

    queries = np.array([[11, 0]] * 50, np.int64)
    place, best = codes.nearest(queries, book.view(Counting))
    assert (place == 1).all() and (best == 1).all() and sum(met) < 3 * 50 + 8
