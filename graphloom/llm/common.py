"""What the corpus operators share: word splitting, hashing, shared tables, Arrow helpers.

Words are maximal runs of ``[^\\x20\\x09-\\x0D]``. Texts travel to Python as UTF-8 bytes, where
``bytes.split()`` cuts at exactly those characters.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.operators.lineage import settled

#: Tables of the corpus operators are compressed as the session has it, which is how they were measured.
saved = partial(settled, compression=None)
U64 = np.uint64
_BATCH_BYTES = 4 << 20


def scan_partitions(df: DataFrame) -> int:
    """Number of partitions the input is read in: the measure of its size that costs no job."""
    return max(1, df.rdd.getNumPartitions())


def as_bytes(column: str):
    """Null text counts as empty; UTF-8 bytes."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def row_key(id: str, text: str, name: str) -> dict:
    """Columns that tell rows by (id, text): the id as text, null apart from any id, and a hash of the text.

    Deduplication and joins on the same two plain columns share one exchange; a null-safe comparison would not.
    """
    return {f"{name}_id": F.coalesce(F.concat(F.lit("="), F.col(quoted(id)).cast("string")), F.lit("")), f"{name}_hash": F.xxhash64(quoted(text))}


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class HashCache(dict):
    """bytes -> 64-bit hash; emptied when it holds ``limit`` entries, so memory is bounded."""

    def __init__(self, limit: int = 250_000, longest: int = 64):
        super().__init__()
        self.limit, self.longest = limit, longest

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[word] = value
        return value


_HASHES = HashCache()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), U64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply) over an array; wraps around."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x9E3779B97F4A7C15)
    x = x ^ (x >> U64(29))
    x = x * U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> U64(32))


def shingle_hashes(hashes: np.ndarray, n: int = 5) -> np.ndarray:
    """Hash of every window of n words; a text of 1 to n-1 words is one shingle, one of none has none."""
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    out = np.zeros(len(hashes) - n + 1, U64)
    for i in range(n):
        out = mix(out + hashes[i : i + len(out)])
    return out


def in_batches(rows: Iterator[tuple], schema: pa.Schema, size: Callable[[tuple], int] | None = None, most: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of at most ``most`` rows or about 4 MB, by ``size``."""
    held, volume = [], 0
    for row in rows:
        held.append(row)
        volume += size(row) if size else 0
        if len(held) >= most or volume >= _BATCH_BYTES:
            yield _batch(held, schema)
            held, volume = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        for i in range(0, batch.num_rows, 500):  # as Python objects only a few rows at a time
            part = batch.slice(i, 500)
            yield from zip(*(part.column(n).to_pylist() for n in names), strict=True)


def arrow_schema(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def map_rows(df: DataFrame, f: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str, size: Callable[[tuple], int] | None = None) -> DataFrame:
    """mapInArrow over tuples: f gets the rows of a partition as an iterator and yields output tuples."""
    from pyspark.sql.types import _parse_datatype_string

    target, names = arrow_schema(_parse_datatype_string(schema)), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(f(rows_of(batches, *names)), target, size)

    return df.mapInArrow(run, schema)


HEAVY = 1000


def by_group(rows: DataFrame, groups: DataFrame, key: list[str], n: str) -> DataFrame:
    """Left join of rows to the one row of their group, whose ``n`` tells how many rows have it.

    Both are stored or cheap to read twice. At most HEAVY groups hold a thousandth of all rows or more;
    those are broadcast, so that no key of the shuffle is common. A null in the key has no group.
    """
    groups = saved(groups, "groups")
    least = rows.count() / HEAVY
    heavy, light = F.broadcast(groups.filter(F.col(n) > least)), groups.filter(F.col(n) <= least)
    return rows.join(heavy, key).unionByName(rows.join(heavy.select(key), key, "left_anti").join(light, key, "left"))


def chunked(values: Iterator, n: int) -> Iterator[list]:
    values = iter(values)
    while part := list(itertools.islice(values, n)):
        yield part
