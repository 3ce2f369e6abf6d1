"""Tables written once in the folder that all executors share, to end a plan that would be run or grow again."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of the larger side that one join or one aggregate of a store shuffles at a time.
SLICE = 1 << 24
_SCRATCH: ContextVar[list | None] = ContextVar("_SCRATCH", default=None)  # (path, table) of the innermost scratch
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, in local mode a folder in the warehouse."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_shared")
        spark.sparkContext.setCheckpointDir(configured)
    return configured


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it ends, not when the driver happens to collect its garbage."""
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if was is None else spark.conf.set(_CLEANUP, was)


def settled(df: DataFrame | list[DataFrame], name: str, compression: str | None = "zstd") -> DataFrame:
    """df as a Parquet table read back; removed when the session's file system closes. ``compression`` None: as the session has it.

    Several frames become one table; each is written, and its shuffle files go, before the next.
    """
    frames = df if isinstance(df, list) else [df]
    spark = frames[0].sparkSession
    path = f"{shared_dir(spark)}/graphloom-{name}-{uuid.uuid4().hex}"
    with cleaned(spark):
        for frame in frames:
            frame.write.parquet(path, mode="append", compression=compression)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    out = spark.read.schema(frames[0].schema).parquet(path)
    if (tables := _SCRATCH.get()) is not None:
        tables.append((path, out))
    return out


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables that are settled inside go at the end. Those stay that the function it gives settles, or is given as they are."""
    mine: list[tuple[str, DataFrame]] = []
    outer = _SCRATCH.get()

    def keep(df: DataFrame, name: str) -> DataFrame:
        for i, (path, table) in enumerate(mine):
            if table is df:
                if outer is not None:
                    outer.append(mine[i])
                del mine[i]
                return df
        token = _SCRATCH.set(outer)
        try:
            return settled(df, name)
        finally:
            _SCRATCH.reset(token)

    token = _SCRATCH.set(mine)
    try:
        yield keep
    finally:
        _SCRATCH.reset(token)
        for path, table in mine:
            hadoop = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def counted(df: DataFrame) -> int:
    with cleaned(df.sparkSession):
        return df.count()


def sliced(n: int, by: list[str], *frames: DataFrame) -> list[tuple[DataFrame, ...]]:
    """The frames cut alike by a hash of the columns ``by``, so that n rows make slices of about SLICE."""
    parts = max(1, -(-n // SLICE))
    at = F.pmod(F.xxhash64(*by), F.lit(parts))
    return [tuple(f.filter(at == i) for f in frames) for i in range(parts)] if parts > 1 else [frames]


def by_slices(n: int, by: list[str], name: str, make: Callable[..., DataFrame], *frames: DataFrame) -> DataFrame:
    """What ``make`` gives of frames whose rows meet by the columns ``by``; of more than SLICE rows a settled table, made slice by slice."""
    made = [make(*slice) for slice in sliced(n, by, *frames)]
    return made[0] if len(made) == 1 else settled(made, name)
