"""Queries opN_<name> of the corpus operators over the whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, chat, codes, exact, jaccard, langid, mixing, neighbours, oracles, packing, quality, scoring, suffixes, tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_json(path: str | None = None) -> str:
    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = tokens.piece_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    return tokens.count_tokens(table(spark, sf_dir, "documents"), vocabulary)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_json())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality(table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"),
    )


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = langid.held_out(F.col("doc_id"))
    model = langid.train(documents.filter(~held_out))
    predicted = langid.predict(documents, model)
    return predicted.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected", "entropy")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = scoring.in_fold(F.col("doc_id"))
    scored = scoring.score(documents, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, spans = mixing.mixture(table(spark, sf_dir, "documents"))
    mixed = mixing.taken(documents, spans)
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    return chat.read_back(chat.examples(rows.unionByName(extra)))


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    return align.align(table(spark, sf_dir, "documents"), tokenizer_json(), model)[0]


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    return exact.duplicates(documents, carry=("text_sha256",))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_packing": op2_packing,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_language_id": op4_language_id,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_mixing": op7_mixing,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_quality_rules": op10_quality_rules,
    "op11_cross_tokenizer_alignment": op11_cross_tokenizer_alignment,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_vector_codes": op13_vector_codes,
}

#: The others can't be restated in SQL (tokenizers, fitted models, draws, byte strings); tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_jaccard_join": oracles.JACCARD,
    "op9_chat_formatting": oracles.CHAT,
    "op10_quality_rules": oracles.QUALITY,
    "op12_exact_dedup": oracles.COPIES,
    "op13_vector_codes": oracles.CODES,
}
