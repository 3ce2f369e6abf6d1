"""Versions of a stored collection: a manifest names the folders of each table, and the newest manifest is the collection.

Folders are written once and never changed. A manifest is written beside the others and renamed to
its number, which fails if another writer took that number first; readers keep the folders of the
manifest they opened.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, folder = _files(spark, path), _path(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(folder)) if fs.exists(folder) else []


def _read(spark: SparkSession, path: str) -> dict:
    stream = _files(spark, path).open(_path(spark, path))
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def numbers(spark: SparkSession, path: str) -> list[int]:
    return [int(n[1:-5]) for n in _names(spark, f"{path}/versions") if n.startswith("v") and n.endswith(".json")]


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """The manifest of a version, by default the newest; None where there is none."""
    known = numbers(spark, path)
    if version is None:
        version = max(known, default=None)
    return _read(spark, f"{path}/versions/v{version:010d}.json") if version in known else None


def commit(spark: SparkSession, path: str, entry: dict, after: int) -> int:
    """``entry`` as the version next to ``after`` (0: the first); an error if another writer was there before."""
    version = after + 1
    held, target = f"{path}/versions/.{uuid.uuid4().hex}", f"{path}/versions/v{version:010d}.json"
    stream = _files(spark, path).create(_path(spark, held), False)
    stream.write(bytearray(json.dumps(entry | {"version": version}, sort_keys=True).encode()))
    stream.close()
    jvm, context = spark.sparkContext._jvm, spark.sparkContext
    rename = context._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, path).toUri(), context._jsc.hadoopConfiguration())
    try:
        files.rename(_path(spark, held), _path(spark, target), rename)
    except Exception as e:
        _files(spark, path).delete(_path(spark, held), False)
        if "FileAlreadyExists" in str(e):
            raise RuntimeError(f"version {version} of {path} was written by another job") from e
        raise
    return version


def folder() -> str:
    """The folder of one commit, inside that of each table."""
    return f"commit={uuid.uuid4().hex}"


def read(spark: SparkSession, path: str, table: str, entry: dict) -> DataFrame:
    """A table of a manifest, whose entry is {"folders": [...], "schema": ...}."""
    home = f"{path}/data/{table}"
    known = spark.read.schema(StructType.fromJson(entry["schema"])).option("basePath", home)
    return known.parquet(*[f"{home}/{f}" for f in entry["folders"]]).drop("commit")


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Drops all but the newest ``keep`` versions, and folders that none of those names; how many commits went."""
    known = numbers(spark, path)
    stay = known[-keep:]
    used = {(t, f) for v in stay for t, e in manifest(spark, path, v)["tables"].items() for f in e["folders"]}
    fs = _files(spark, path)
    for v in known[:-keep]:
        fs.delete(_path(spark, f"{path}/versions/v{v:010d}.json"), False)
    gone = [(t, f) for t in _names(spark, f"{path}/data") for f in _names(spark, f"{path}/data/{t}") if (t, f) not in used]
    for t, f in gone:
        fs.delete(_path(spark, f"{path}/data/{t}/{f}"), True)
    return len({f for _, f in gone})
