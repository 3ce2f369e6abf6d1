"""Operator 13: vector code compression, with annular norm pruning in the search of a codebook.

Vectors become integers, are cut into equal parts, and each part of a vector is told by the nearest
entry of that position's codebook. Entries are sorted by norm. A query starts at the entry of
nearest norm; by the triangle inequality an entry as near as the best so far has a norm that
differs from the query's by no more than that distance, so a binary search gives an interval, and
all entries of that annulus, its rims included, are evaluated exactly on integers. The interval
shrinks as better entries are met.

Codebooks start as the parts of the vectors of smallest ids and are refined by rounds: each task
sums the parts of its vectors by entry, Spark adds the sums up, and the driver holds the codebooks
alone, ``entries`` x length integers for each length of vector.

Defined results: rows whose vector is null or holds a null or non-finite component are left out.
Components are floor(scale * x), cut off at the size beyond which a squared distance would leave 64
bits (46,340 for x at 64 dimensions and scale 4096). Ties go to the smaller index. Vectors of
different lengths have codebooks of their own; a length that the parts don't divide is filled up
with zeros; empty vectors have code 0 and error 0. Fewer vectors than entries give fewer entries.
Null ids sort last, equal ids by their vectors. Repeated rows count as often as they occur. An empty
table gives no rows. Errors of a group that add up to more than 64 bits are null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_group, quoted, saved

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
ROWS = 20_000  # vectors a task holds as arrays at a time
Books = dict[int, np.ndarray]  # length -> (parts, entries, width)


def _limit(length: int) -> int:
    return int((2**63 / max(1, length)) ** 0.5 / 2) - 1


def _as_integers(df: DataFrame, id: str, vector: str, carry: tuple[str, ...], scale: int, parts: int) -> DataFrame:
    """_id, carried columns, _length, _v (array of long, filled up to a multiple of parts)."""
    v = F.col(quoted(vector))
    whole = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    kept = df.filter(whole).select(F.col(quoted(id)).alias("_id"), *[F.col(quoted(c)).alias(f"_carry{i}") for i, c in enumerate(carry)], v.alias("_x"))
    most = F.floor(F.sqrt(F.lit(2.0**63) / F.greatest(F.lit(1), F.size("_x"))) / 2) - 1
    level = lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, -F.col("_most").cast("double")), F.col("_most").cast("double")))
    filled = F.concat(F.transform("_x", level), F.array_repeat(F.lit(0).cast("long"), F.pmod(-F.size("_x"), F.lit(parts)).cast("int")))
    return kept.withColumn("_most", most).withColumn("_v", filled).withColumn("_length", F.size("_v")).drop("_x", "_most")


def nearest(queries: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest row of ``book`` (int64) for each query; ties to the smaller index."""
    norms = np.sqrt((book.astype(float) ** 2).sum(1))
    order = np.argsort(norms, kind="stable")
    norms, book = norms[order], book[order]
    own = np.sqrt((queries.astype(float) ** 2).sum(1))
    slack = 1e-9 * (own + norms[-1]) + 1e-6  # of rounding: an annulus may only be too wide
    at = np.clip(np.searchsorted(norms, own), 0, len(norms) - 1)
    below = np.maximum(at - 1, 0)
    at = np.where(own - norms[below] < norms[at] - own, below, at)
    best, place = ((queries - book[at]) ** 2).sum(1), order[at]
    # outwards from the start, one entry a side and step, as long as the annulus of the best so far holds it
    for step, first in ((1, at + 1), (-1, at - 1)):
        alive, entry = np.arange(len(queries)), first
        while len(alive):
            reach = np.sqrt(best[alive].astype(float)) + slack[alive]
            rim = np.searchsorted(norms, own[alive] + reach, "right") if step > 0 else np.searchsorted(norms, own[alive] - reach, "left") - 1
            inside = entry[alive] < rim if step > 0 else entry[alive] > rim
            alive = alive[inside]
            if not len(alive):
                break
            met = entry[alive]
            d = ((queries[alive] - book[met]) ** 2).sum(1)
            better = (d < best[alive]) | ((d == best[alive]) & (order[met] < place[alive]))
            best[alive[better]], place[alive[better]] = d[better], order[met][better]
            entry[alive] = met + step
    return place, best


def assigned(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows, parts) and squared distances of vectors (rows, length)."""
    parts, _, width = books.shape
    cut = vectors.reshape(len(vectors), parts, width)
    found = [nearest(cut[:, p], books[p]) for p in range(parts)]
    return np.stack([c for c, _ in found], 1), np.stack([e for _, e in found], 1)


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, vectors) of a batch."""
    lengths = batch.column("_length").to_numpy(zero_copy_only=False)
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        for i in range(0, len(rows), ROWS):
            some = rows[i : i + ROWS]
            yield int(length), some, batch.column("_v").take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).reshape(len(some), int(length))


SUMS = "length int, part int, entry int, n long, sums array<long>"


def _sums(vectors: DataFrame, books: Books) -> dict[tuple[int, int, int], tuple[int, list[int]]]:
    """(length, part, entry) -> how many parts are assigned to it, and their sums; unused entries are absent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for length, _, v in _vectors(batch):
                b = books[length]
                codes, _ = assigned(v, b)
                count, sums = total.setdefault(length, (np.zeros(b.shape[:2], np.int64), np.zeros(b.shape, np.int64)))
                for p in range(b.shape[0]):
                    count[p] += np.bincount(codes[:, p], minlength=b.shape[1])
                    np.add.at(sums[p], codes[:, p], v.reshape(len(v), b.shape[0], b.shape[2])[:, p])
        rows = [(length, p, e, int(count[p, e]), sums[p, e].tolist()) for length, (count, sums) in total.items() for p, e in zip(*np.nonzero(count))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())])], names=["length", "part", "entry", "n", "sums"])

    partial = vectors.select("_length", "_v").mapInArrow(run, SUMS).select("*", F.posexplode("sums").alias("at", "x"))
    # sums of all vectors may leave 64 bits
    added = partial.groupBy("length", "part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("s"))
    out: dict = {}
    for r in added.orderBy("length", "part", "entry", "at").collect():  # as many rows as the codebooks have components
        out.setdefault((r["length"], r["part"], r["entry"]), (r["n"], []))[1].append(int(r["s"]))
    return out


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Books:
    """Codebooks of each length of stored integer vectors (_id, _length, _v)."""
    books: Books = {}
    for length in sorted(r["_length"] for r in vectors.select("_length").distinct().collect()):
        if length:
            first = vectors.filter(F.col("_length") == length).orderBy(F.asc_nulls_last("_id"), "_v").limit(entries).select("_v").collect()
            books[length] = np.array([r["_v"] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)
    for _ in range(rounds if books else 0):
        held = vectors.filter(F.col("_length") > 0)
        for (length, part, entry), (n, sums) in _sums(held, books).items():
            books[length][part, entry] = [s // n for s in sums]
    return books


def digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def compress(df: DataFrame, id: str = "vec_id", vector: str = "embedding", group: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """One row a vector: id, code, error, <group>_error (of all rows of the group, nulls together), codebooks_sha256."""
    vectors = saved(_as_integers(df, id, vector, (group,), scale, parts), "vectors")
    books = train(vectors, parts, entries, rounds)
    digests = {length: digest(b) for length, b in books.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error, sha = np.full(batch.num_rows, "00" * parts, object), np.zeros(batch.num_rows, np.int64), np.full(batch.num_rows, digest(np.zeros(0, int)), object)
            for length, rows, v in _vectors(batch):
                if length:
                    codes, errors = assigned(v, books[length])
                    code[rows], error[rows], sha[rows] = [bytes(c).hex() for c in codes.astype(np.uint8)], errors.sum(1), digests[length]
            kept = [batch.column(n) for n in ("_id", "_carry0")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(code, pa.string()), pa.array(error), pa.array(sha, pa.string())], names=["_id", "_group", "code", "error", "codebooks_sha256"])

    kind = {f.name: f.dataType.simpleString() for f in vectors.schema}
    coded = vectors.mapInArrow(run, f"_id {kind['_id']}, _group {kind['_carry0']}, code string, error long, codebooks_sha256 string")
    coded = saved(coded.withColumn("_key", F.coalesce(F.concat(F.lit("="), F.col("_group").cast("string")), F.lit(""))), "coded")
    # null on overflow; the key tells null apart from any value
    total = coded.groupBy("_key").agg(F.expr("try_sum(error)").alias("_error"), F.count("*").alias("_n"))
    out = by_group(coded, total, ["_key"], "_n")
    return out.select(F.col("_id").alias(id), "code", "error", F.col("_error").alias(f"{group}_error"), "codebooks_sha256")
