"""Cases of ties, repeated ids and many labels."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import chat, langid, mixing, neighbours

from .conftest import frame, prose


def test_one_id_with_several_vectors(spark):
    """Each row is a query and a candidate of its own."""
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(41, 8)).round(3)
    ids = [0, 0, 0, *range(1, 39)]
    rows = list(zip(ids, vectors.tolist())) + [(7, vectors[9].tolist())]  # and one vector with two ids
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") == 0, k=5, search=10_000).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], round(r["score"], 9)))
    want = []
    for q in range(3):
        cos = [(-(vectors[q] @ np.array(v)) / np.linalg.norm(vectors[q]) / np.linalg.norm(v), i) for k, (i, v) in enumerate(rows) if k != q]
        want += [(n + 1, i, round(-c, 9)) for n, (c, i) in enumerate(sorted(cos)[:5])]
    assert sorted(got[0]) == sorted(want) and len(got[0]) == 15


def test_tied_turns_sort_by_raw_texts(spark):
    """Escapes change the order of texts; turns sort by what they say. Repeated rows are turns, extra columns do nothing."""
    rows = [(1, 0, "user", "<a"), (1, 0, "user", "<|end|>"), (1, 0, "user", "<|end|>"), (1, 1, "assistant", "b\\"), (1, 1, "assistant", "b["), (2, None, "assistant", None), (2, 0, None, "x")]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "conv_id long, turn long, role string, text string, turns string, example int, t string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.examples(df)).collect()}
    for conv in (1, 2):
        turns = sorted(((t is not None, t or 0), r or "", x or "") for c, t, r, x in rows if c == conv)
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_more_labels_than_five_hundred(spark):
    """Every label is learned, the rarest too."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(560):
        word = letters[k % 26] * 3 + letters[k // 26] * 4
        rows += [(10 * k + j, f"{word} {word}{letters[j]} {word}", f"l{k:03d}") for j in range(2)]
    model = langid.train(frame(spark, rows))
    assert len(model["languages"]) == 560
    predicted = {r["doc_id"]: r["lang_pred"] for r in langid.predict(frame(spark, rows[::40]), model).collect()}
    assert predicted == {i: label for i, _, label in rows[::40]}


def test_sample_of_a_table_that_repeats_ids(spark, monkeypatch):
    """Rows of few ids are drawn by their texts, so the sample is neither all nor nothing."""
    monkeypatch.setattr(langid, "SAMPLE_TOTAL", 200)
    seen = []
    fit = langid.fit
    monkeypatch.setattr(langid, "fit", lambda words, counts, order: (seen.append(int(counts.sum())), fit(words, counts, order))[1])
    rows = [(i % 2, prose(i, 5), "a" if i % 3 else "b") for i in range(3000)]
    langid.train(frame(spark, rows), sample_docs=100)
    assert len(seen) == 2 and all(5 * 40 < n < 5 * 160 for n in seen)


def test_one_text_in_two_sources(spark):
    """Each source's words come out under its own name, as many as the mix takes of them."""
    rows = [(1, prose(1, 300), None, "a"), (1, prose(1, 300), None, "b"), (2, prose(2, 200), None, "a"), (3, prose(3, 400), None, "b"), (4, prose(4, 100), None, None)]
    df = frame(spark, rows)
    documents, spans = mixing.mixture(df)
    want = {(r["id"], r["source"]): r["taken"] for r in mixing.taken(documents, spans).collect()}
    got = {}
    for r in mixing.mixed_documents(df).collect():
        got[r["doc_id"], r["source"]] = got.get((r["doc_id"], r["source"]), 0) + len(r["text"].split())
    assert got == {k: n for k, n in want.items() if n} and len(got) == 5
