"""The registered corpus queries over the smallest driver tables: their SQL, their columns, repeated runs."""

import os

import duckdb
import pytest

from graphloom.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are absent")
FIRST = {
    "op2_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op4_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op5_lm_scoring": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op6_nearest_neighbours": ["query_id", "rank", "vec_id", "score"],
    "op7_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op8_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op9_chat_formatting": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op11_cross_tokenizer_alignment": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
    "op12_exact_dedup": ["doc_id", "text_sha256", "keep_id", "group_size", "kept"],
    "op13_vector_codes": ["vec_id", "code", "error", "label_error", "codebooks_sha256"],
    "op10_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    want = con.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in df.columns]
    assert sorted(tuple(r) for r in df.collect()) == sorted(tuple(r[i] for i in order) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(FIRST))
def test_columns(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.columns[: len(FIRST[name])] == FIRST[name] and df.count() > 0


@pytest.mark.parametrize("name", ["op5_lm_scoring", "op7_mixing"])
def test_reruns_agree(spark, name):
    runs = [sorted(tuple(r) for r in QUERIES[name](spark, DATA).collect()) for _ in range(2)]
    assert runs[0] == runs[1]
