"""A corpus pipeline of five operators: quality rules, near-duplicates, repeated strings, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as
the next one's docs. All but the last return the columns of documents. A stage works on all that
its predecessor kept:

- quality rules: documents that a rule rejects go;
- Jaccard join: of each class of near-duplicates the document of smallest id stays;
- suffix dedup: bytes that repeat an earlier string of 100 bytes are cut out of the texts;
- mixing: rows are what the mix takes of each document, once for each pass over it;
- packing: pieces of token sequences, with their ids.
"""

from __future__ import annotations

from collections.abc import Callable

from graphloom.llm import jaccard, mixing, packing, quality, suffixes
from graphloom.llm.common import saved
from graphloom.llm.queries import tokenizer_json
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars follows a text that a stage has changed."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(suffixes.without_repeats(docs))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(mixing.mixed_documents(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_json())


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("jaccard_join", near_duplicates),
    ("suffix_dedup", repeated_strings),
    ("mixing", mixed_sources),
    ("packing", packed),
]

#: Near-duplicates, tokens and draws can't be restated in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
