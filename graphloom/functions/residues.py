"""Residue tables: physico-chemical vectors and one-hot codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Seven published amino-acid descriptors by residue.
DESCRIPTORS = {
    "ALA": (1.28, 0.05, 1.00, 0.31, 6.11, 0.42, 0.23),
    "ARG": (2.34, 0.29, 6.13, -1.01, 10.74, 0.36, 0.25),
    "ASN": (1.60, 0.13, 2.95, -0.60, 6.52, 0.21, 0.22),
    "ASP": (1.60, 0.11, 2.78, -0.77, 2.95, 0.25, 0.20),
    "CYS": (1.77, 0.13, 2.43, 1.54, 6.35, 0.17, 0.41),
    "GLN": (1.56, 0.18, 3.95, -0.22, 5.65, 0.35, 0.25),
    "GLU": (1.56, 0.15, 3.78, -0.64, 3.09, 0.42, 0.21),
    "GLY": (0.00, 0.00, 0.00, 0.00, 6.07, 0.13, 0.15),
    "HIS": (2.99, 0.23, 4.66, 0.13, 7.69, 0.27, 0.30),
    "ILE": (4.19, 0.19, 4.00, 1.80, 6.04, 0.30, 0.45),
    "LEU": (2.59, 0.19, 4.00, 1.70, 6.04, 0.39, 0.31),
    "LYS": (1.89, 0.22, 4.77, -0.99, 9.99, 0.32, 0.27),
    "MET": (2.35, 0.22, 4.43, 1.23, 5.71, 0.38, 0.32),
    "PHE": (2.94, 0.29, 5.89, 1.79, 5.67, 0.30, 0.38),
    "PRO": (2.67, 0.00, 2.72, 0.72, 6.80, 0.13, 0.34),
    "SER": (1.31, 0.06, 1.60, -0.04, 5.70, 0.20, 0.28),
    "THR": (3.03, 0.11, 2.60, 0.26, 5.60, 0.21, 0.36),
    "TRP": (3.21, 0.41, 8.08, 2.25, 5.94, 0.32, 0.42),
    "TYR": (2.94, 0.30, 6.47, 0.96, 5.66, 0.25, 0.41),
    "VAL": (3.67, 0.14, 3.00, 1.22, 6.02, 0.27, 0.49),
    "UNK": (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
}
# One-letter codes; their alphabetical order is the order of the one-hot code.
LETTERS = dict(ALA="A", ARG="R", ASN="N", ASP="D", CYS="C", GLN="Q", GLU="E", GLY="G", HIS="H", ILE="I", LEU="L", LYS="K", MET="M", PHE="F", PRO="P", SER="S", THR="T", TRP="W", TYR="Y", VAL="V")
DIMENSIONS = [f"dim_{i}" for i in range(1, 8)]
ONE_HOT_ORDER = sorted(LETTERS, key=LETTERS.get)


def descriptors(spark: SparkSession) -> DataFrame:
    """residue_name, dim_1 .. dim_7: 21 rows."""
    rows = [(k, *v) for k, v in DESCRIPTORS.items()]
    return spark.createDataFrame(rows, "residue_name string, " + ", ".join(f"{d} double" for d in DIMENSIONS))


def with_descriptors(nodes: DataFrame, strict: bool = False) -> DataFrame:
    """nodes with dim_1 .. dim_7; residues outside the table get NULL, or raise when ``strict``."""
    joined = nodes.join(F.broadcast(descriptors(nodes.sparkSession)), "residue_name", "left")  # 21 rows
    if strict:
        known = F.when(F.col("dim_1").isNull(), F.raise_error(F.concat(F.lit("unknown residue "), F.coalesce("residue_name", F.lit("NULL"))))).otherwise(F.col("dim_1"))
        joined = joined.withColumn("dim_1", known)
    return joined


def one_hot(residue: Column) -> Column:
    """array<int> of 20; all zero for UNK, NULL for residues outside the table."""
    place = F.array_position(F.array(*map(F.lit, ONE_HOT_ORDER)), residue) - 1
    code = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: (i == place).cast("int"))
    return F.when((place >= 0) | (residue == "UNK"), code)
