import hashlib
import random
from collections import defaultdict

import pytest

from graphloom.llm import exact

from .conftest import EXTRA, frame, prose


def by_hand(rows):
    groups = defaultdict(list)
    for id, text in rows:
        groups[text or ""].append(id)
    least = float("-inf")
    out = []
    for text, ids in groups.items():
        keep = max(ids, key=lambda i: least if i is None else i)
        out += [(i, keep, len(ids)) for i in ids]
    return sorted(out, key=str), len(groups)


def got(df):
    rows = df.collect()
    return sorted([(r["doc_id"], r["keep_id"], r["group_size"]) for r in rows], key=str), sum(r["kept"] for r in rows), rows


def test_odd_rows(spark, odd):
    plain = [(r["doc_id"], r["text"]) for r in odd.collect()]
    found, kept, rows = got(exact.duplicates(odd))
    assert (found, kept) == by_hand(plain)
    assert all(r["doc_id"] == r["keep_id"] for r in rows if r["kept"])


def test_texts_that_differ_late(spark):
    """Equal lengths and prefixes, and then another last character."""
    head = "a" * 300
    texts = [head + "x", head + "y", head + "x", head + "z" * 2, "b" * 301, "b" * 300 + "x", "ä" * 150 + "x", "ä" * 150 + "y", "ä" * 150 + "y"]
    rows = list(enumerate(texts))
    found, kept, _ = got(exact.duplicates(frame(spark, rows)))
    assert (found, kept) == by_hand(rows)


def test_case_and_space_tell_texts_apart(spark):
    rows = [(1, "One text"), (2, "one text"), (3, "One text "), (4, "One  text"), (5, "é"), (6, "é")]
    found, kept, _ = got(exact.duplicates(frame(spark, rows)))
    assert kept == 6 and (found, kept) == by_hand(rows)


def test_no_rows(spark, nothing):
    assert exact.duplicates(nothing).collect() == []
    assert exact.duplicates(nothing).columns == ["doc_id", "keep_id", "group_size", "kept"]


def test_a_third_of_all_rows_is_one_text(spark):
    rng = random.Random(3)
    rows = [(i, "the same" if i % 3 == 0 else prose(rng.randrange(900), 20)) for i in range(3000)]
    found, kept, _ = got(exact.duplicates(frame(spark, rows)))
    assert (found, kept) == by_hand(rows)


def test_a_slot_taken_for_another_costs_no_result(spark, monkeypatch):
    monkeypatch.setattr(exact, "SLOTS", 2)
    rows = [(i, prose(i % 40, 10)) for i in range(100)]
    found, kept, _ = got(exact.duplicates(frame(spark, rows)))
    assert (found, kept) == by_hand(rows)


def test_carried_columns(spark, odd):
    rows = exact.duplicates(odd, carry=("text", *EXTRA)).collect()
    assert {(r["doc_id"], r["text"]) for r in rows} == {(r["doc_id"], r["text"]) for r in odd.collect()}
    assert all(r[c] == "x" for r in rows for c in EXTRA)


def test_ids_of_text(spark):
    df = spark.createDataFrame([("a", "t"), ("c", "t"), ("b", "t"), ("z", "u")], "`my id` string, `my text` string")
    rows = exact.duplicates(df, "my id", "my text").collect()
    assert {(r["my id"], r["keep_id"], r["kept"]) for r in rows} == {("a", "c", False), ("b", "c", False), ("c", "c", True), ("z", "z", True)}


@pytest.mark.parametrize("length", [0, 1, 100_000])
def test_digest_is_of_the_whole_text(spark, length):
    """Texts of one length that differ in the last byte alone are two groups."""
    rows = [(1, "q" * length + "a"), (2, "q" * length + "b"), (3, "q" * length + "a")]
    found, kept, _ = got(exact.duplicates(frame(spark, rows)))
    assert (found, kept) == by_hand(rows) and kept == len({hashlib.sha256(t.encode()).digest() for _, t in rows})
