"""Readers of the text formats that collections come with. All declare their schema; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCOPE = "domain_id string, pdb string, region string, sccs string, sunid long, hierarchy string"
SPLITS = "id string, y string, split string"
SAMPLES = "timestamp long, memory string"


LINE = ["file", "start", "at"]


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value, and LINE: columns that sort lines as they stand in their file, in however many splits it is read.

    They are the file, the byte at which the split starts, and the order of rows inside the task, which reads
    a split from its start to its end.
    """
    text = spark.read.text(path)
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))


def code_list(spark: SparkSession, path: str) -> DataFrame:
    """(code, file, start, at): one a line, upper-cased, with its place; lines that start with # are comments; an empty line is an empty code."""
    return lines(spark, path).filter(~F.col("value").startswith("#")).select(F.upper(F.trim("value")).alias("code"), *LINE)


def tsv(spark: SparkSession, path: str, schema: str = SCOPE) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("comment", "#").csv(path)


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV whose first line names its columns."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def split(spark: SparkSession, path: str, name: str | None = None, schema: str = SPLITS) -> DataFrame:
    """(id, y, split) of a benchmark table with a header, of one split or all."""
    rows = csv(spark, path, schema)
    return rows if name is None else rows.filter(F.col("split") == name)


def samples(spark: SparkSession, path: str, schema: str = SAMPLES) -> DataFrame:
    """Headerless CSV."""
    return spark.read.schema(schema).csv(path)


def numbers(spark: SparkSession, path: str) -> DataFrame:
    """(value): one double a line, blank lines skipped."""
    text = spark.read.text(path).select(F.trim("value").alias("value"))
    return text.filter("value <> ''").select(F.col("value").cast("double").alias("value"))


FILE = r"([^/]+?)(?:\.[^./]*)?$"


def structures(spark: SparkSession, path: str, code: str = FILE) -> DataFrame:
    """Atoms of fixed-width structure files: code (what the pattern ``code`` finds in the path, by default the file name), model, record, serial, atom_type, alternate, residue_name, chain_id, residue_number, insertion, x, y, z, b_factor, element_symbol.

    Columns are those of the public PDB format. A record of the reader is a model, which ends at its
    own line; the format's five-digit serials bound its size, so a file of any number of models is
    read in splits. Atoms outside models are of model 1. Blank ``alternate`` and ``insertion`` are
    empty strings; numbers that don't parse are null.
    """
    models = spark.read.option("lineSep", "\nENDMDL").text(path).select("value", F.upper(F.regexp_extract(F.input_file_name(), code, 1)).alias("code"))
    numbered = models.withColumn("model", F.coalesce(F.regexp_extract("value", r"(?m)^MODEL +(\d+)", 1).try_cast("int"), F.lit(1)))
    lines = numbered.select("code", "model", F.explode(F.split("value", r"\r?\n")).alias("value"))
    cut = lambda a, n: F.trim(F.substring("value", a, n))
    number = lambda a, n: cut(a, n).try_cast("double")
    atoms = lines.filter(F.substring("value", 1, 6).isin("ATOM  ", "HETATM"))
    return atoms.select(
        "code", "model", F.substring("value", 1, 6).alias("record"), cut(7, 5).try_cast("int").alias("serial"), cut(13, 4).alias("atom_type"), cut(17, 1).alias("alternate"),
        cut(18, 3).alias("residue_name"), cut(22, 1).alias("chain_id"), cut(23, 4).try_cast("int").alias("residue_number"), cut(27, 1).alias("insertion"),
        number(31, 8).alias("x"), number(39, 8).alias("y"), number(47, 8).alias("z"), number(61, 6).alias("b_factor"), cut(77, 2).alias("element_symbol"),
    )


def _first_model(atoms: DataFrame) -> DataFrame:
    first = atoms.groupBy("code").agg(F.min("model").alias("model"))
    return atoms.join(first, ["code", "model"], "left_semi")


def raw_nodes(atoms: DataFrame, granularity: str = "CA", model: int | None = None, insertions: bool = True, order: DataFrame | None = None) -> DataFrame:
    """Ingest rows from parsed atoms of one model, by default the first by number that a file has: all of them at atom granularity, else those of the named atom type.

    Of an atom's alternate places the first by serial counts. An inserted residue is one of its own,
    with the insertion code behind its number; ``insertions=False`` leaves such residues out. ``seq``
    comes from ``order`` (graph_code, seq), whose codes are the ones kept; without it ``seq`` is 0.
    """
    kept = atoms.filter(F.col("model") == model) if model is not None else _first_model(atoms)
    kept = kept if granularity == "atom" else kept.filter(F.col("atom_type") == granularity)
    kept = kept if insertions else kept.filter("insertion = ''")
    label = [F.col("chain_id"), F.col("residue_name"), F.concat(F.col("residue_number").cast("string"), "insertion")]
    label += [F.col("atom_type")] if granularity == "atom" else []
    first = kept.groupBy(F.col("code").alias("graph_code"), F.concat_ws(":", *label).alias("node_label")).agg(F.min_by(F.struct("x", "y", "z", "b_factor"), "serial").alias("at"), F.min("serial").alias("pos"))
    placed = first.withColumn("seq", F.lit(0)) if order is None else first.join(order, "graph_code")
    return placed.select("graph_code", F.col("seq").cast("long").alias("seq"), F.col("pos").cast("long").alias("pos"), "node_label", F.array("at.x", "at.y", "at.z").alias("coords"), F.col("at.b_factor").alias("b_factor"))
