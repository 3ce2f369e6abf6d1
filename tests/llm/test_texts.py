"""Operators that look at one text at a time: token counts, packing, quality rules, chat formatting."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from graphloom.llm import chat, packing, quality, tokens
from graphloom.llm.queries import tokenizer_json

from .conftest import frame, prose


@pytest.fixture(scope="module")
def vocabulary():
    return tokens.piece_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def exact(vocabulary):
    t = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=tokens.SPACE, prepend_scheme="always", split=True)
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def test_counts_equal_the_exact_tokenizer(vocabulary, exact):
    counter, rng = tokens.Counter(vocabulary), random.Random(4)
    texts = ["", " ", "  a  b ", "a\n\tb", "<unk>", "x<unk>💩💩<unk>", "<0x41>", "x" * 2000, "漢字カタカナ"]
    texts += ["".join(rng.choice(" ▁abécthe💩漢\n<unk>0x41") for _ in range(rng.randint(0, 50))) for _ in range(800)]
    assert [counter.tokens(t) for t in texts] == [exact(t) for t in texts]


def test_ties_go_to_the_longest_piece():
    vocabulary = [("<unk>", -9.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0)]
    counter = tokens.Counter(vocabulary)
    assert counter.tokens("ab") == 2  # ▁a + b or ▁ + ab or ▁ + a + b, all of one score


def test_counts_of_odd_rows(odd, nothing, vocabulary, exact):
    got = tokens.count_tokens(odd, vocabulary)
    want = Counter((r.doc_id, exact(r.text or "")) for r in odd.collect())
    assert Counter((r.doc_id, r.n_tokens) for r in got.collect()) == want
    assert tokens.count_tokens(nothing, vocabulary).count() == 0


def check_packed(rows, texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((d, tuple(t.encode(x or "", add_special_tokens=False).ids + [0])) for d, x in texts)
    pieces, held = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length > 0
        pieces[r.doc_id, r.doc_tokens].append((r.start, ids))
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY
    total = Counter()
    for (doc, n), parts in pieces.items():
        copies = Counter(start for start, _ in parts)
        assert len(set(copies.values())) == 1 or doc in {4, 7}
        ids = [i for start, part in sorted({(s, tuple(p)) for s, p in parts}) for i in part]
        total[doc, tuple(ids)] += min(copies.values())
        assert len(ids) == n
    assert total == want
    return sum(packing.CAPACITY - f for f in (sum(n for _, n in p) for p in held.values()) if f & (f - 1))


def test_packing_covers_every_token(odd, nothing):
    rows = packing.pack(odd, tokenizer_json()).collect()
    check_packed(rows, [(r.doc_id, r.text) for r in odd.collect()])
    assert packing.pack(nothing, tokenizer_json()).count() == 0


def test_packing_pads_little(spark):
    texts = [(i, prose(i, 5 + 37 * i % 900) + " <|endoftext|>") for i in range(120)]
    rows = packing.pack(frame(spark, texts).coalesce(2), tokenizer_json()).collect()
    assert check_packed(rows, texts) < 0.01 * sum(r.length for r in rows)


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|endoftext|><|endoftext|>x", " <|endoftext", " " * 1_000_000, "a" + " " * 1_000_000 + "b", "\n" * 1_000_000, "x\u3000" + "\t \u2003" * 300_000 + "<|endoftext|> y", "x" * 1_000_000])
def test_ids_equal_the_tokenizer(text):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.encoder(tokenizer_json())(text) == t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [1, 63, 64, 1023, 1024, 1025, 5000])
def test_cuts(n):
    parts = list(packing.cuts(n))
    assert sum(parts) == n and all(p <= packing.CAPACITY for p in parts)


def brute(text):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", text or "") if w]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            hit |= set(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if x.strip("\x20\x09\x0a\x0b\x0c\x0d")]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_quality_measures(spark, odd, nothing):
    rng = random.Random(2)
    made = ["\n".join(rng.choice(["a b c d e f", "# $ x", "…", "é漢 \x0b y", ""]) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string"))
    got = Counter(tuple(r)[:6] for r in quality.quality(docs).collect())
    assert got == Counter((r.doc_id, *brute(r.text)) for r in docs.collect())
    assert quality.quality(nothing).count() == 0 and quality.filter_documents(nothing).count() == 0


def test_verdict_does_not_depend_on_the_order(odd):
    a, b = list(quality.RULES), list(quality.RULES)[::-1]
    kept = lambda order: sorted(((r.doc_id, r.kept) for r in quality.quality(odd, order=order, measures=False).collect()), key=str)
    assert kept(a) == kept(b)
    assert sorted(quality.estimate(odd)) == sorted(a)
    passed = quality.filter_documents(odd)
    assert passed.columns == odd.columns and passed.count() == sum(k for _, k in kept(a))


def test_quality_keeps_prose_and_rejects_junk(spark):
    docs = frame(spark, [(1, prose(3, 300)), (2, "### $$$ ||| " * 40), (3, "buy it now today friend\n" * 30), (4, "short"), (5, "1 2 3 4 5 6 7 8 9 10 11 12 13")])
    assert {r.doc_id for r in quality.quality(docs).collect() if r.kept} == {1}


CONV = "conv_id long, turn long, role string, text string"


def digests(rows):
    turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in rows)
    loss = "".join(r[3] or "" for r in rows if r[2] == "assistant")
    return len(rows), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat_round_trip(spark):
    rng = random.Random(5)
    bits = [*chat.CONTROL, "\\", "\\\\", "a", "<", "|", "\n", "é💩", "$1", "[/", "user"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "<|text|>"]), rng.choice([None, "", "".join(rng.choice(bits) for _ in range(12))])) for c in [*range(40), None] for t in range(rng.randint(1, 6))]
    got = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(chat.examples(spark.createDataFrame(rows, CONV).repartition(3))).collect()}
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    assert got == {c: digests(rs) for c, rs in groups.items()}


def test_chat_examples_train_one_reply_each(spark):
    rows = [(1, 0, "user", "q1"), (1, 1, "assistant", "a</s>1"), (1, 2, "user", "q2"), (1, 3, "assistant", "a2"), (2, 0, "user", "only")]
    got = chat.examples(spark.createDataFrame(rows, CONV)).orderBy("conv_id", "example").collect()
    assert [(r.conv_id, r.n_turns) for r in got] == [(1, 2), (1, 4), (2, 1)]
    masked = [r.formatted[r.loss_start : r.loss_start + r.loss_length] for r in got]
    assert masked == ["a<\\/s>1", "a2", ""]
    assert got[1].formatted.startswith(got[0].formatted)
    assert chat.examples(spark.createDataFrame([], CONV)).count() == 0


def test_crc_of_pieces(spark):
    row = packing.pack(frame(spark, [(1, "hello world")]), tokenizer_json()).select("ids", F.crc32("ids").alias("c")).first()
    assert zlib.crc32(row.ids) == row.c
