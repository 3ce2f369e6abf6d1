"""Operators that compare texts with each other or learn from all of them."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import jaccard, langid, mixing, neighbours, scoring, suffixes
from graphloom.llm.components import components

from .conftest import frame, prose


def shingles(text):
    words = (text or "").encode().split()
    n = min(5, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else frozenset()


def classes(rows):
    """doc number -> (class, links) by comparing all pairs."""
    sets, parent, links = [shingles(t) for _, t in rows], list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 9 * both >= 4 * (len(sets[a]) + len(sets[b])):
            links[a], links[b] = links[a] + 1, links[b] + 1
            parent[max(find(a), find(b))] = min(find(a), find(b))
    low = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        low[find(i)].append(d)
    return Counter((rows[i][0], min((d for d in low[find(i)] if d is not None), default=None) if sets[i] else rows[i][0], links[i]) for i in range(len(rows)))


def near_copies(seed, n, words=120):
    rng, base = random.Random(seed), prose(seed, words).split()
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(words)] = f"edit{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("leaf", [2_048, 6])
def test_jaccard_join_equals_all_pairs(spark, monkeypatch, leaf):
    monkeypatch.setattr(jaccard, "LEAF", leaf)  # small: nodes are split again and compared in blocks
    monkeypatch.setattr(jaccard, "BLOCK", max(4, leaf // 2))
    passage = prose(77, 40)
    texts = near_copies(1, 25) + near_copies(2, 3) + [prose(i, 90) for i in range(100, 120)] + [f"{prose(i, 150)} {passage}" for i in range(200, 220)] + [prose(5, 70)] * 4 + ["a b c", "a b c", "a b", "", None]
    rows = list(enumerate(texts))
    got = jaccard.jaccard_join(frame(spark, rows).repartition(3))
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got.collect()) == classes(rows)


def test_draws_grow_with_the_split_starts(spark):
    def draws(splits, n, starts, split):
        return spark.range(1).select(jaccard.more_draws(splits, 0.8, F.lit(n), F.lit(starts), F.lit(split))).first()[0]

    assert draws(2, 100, 16, 1) == 0 and draws(2, 100, 16, 16) > 0 and draws(2, 100, 2, 2) >= draws(2, 100, 16, 16)
    assert [draws(k, 100, 16, 16) for k in range(1, 6)] == sorted(draws(k, 100, 16, 16) for k in range(1, 6))
    assert draws(2, 5, 5, 3) == 0 and draws(2, 5, 5, 5) > draws(2, 100, 16, 16)  # two starts that weren't split: a pair differs in one token; short sets have few starts
    assert all(0 < x <= 1 for k in range(6) for x in jaccard.survival(k, 0.8))


@pytest.mark.parametrize("splits", [1, 2])
def test_survival_of_splits(splits):
    """The share of pairs that part, against the rule of paths() played out over random ranks."""
    rng, size, both, rounds = np.random.default_rng(splits), 16, 13, 3000
    rank = lambda *key: zlib.crc32(repr(key).encode()) / 2**32

    def children(salt, path, tokens):
        left = [t for t in tokens if t not in path]
        first = min(left, key=lambda t: rank(salt, path, t))
        return {t for t in left if rank(salt, path, t) * len(left) < jaccard.CHILDREN or t == first}

    def together(salt, path, a, b, k):
        return k == 0 or any(together(salt, (*path, t), a, b, k - 1) for t in children(salt, path, a) & children(salt, path, b))

    a, b = list(range(size)), [*range(both), *range(100, 100 + size - both)]
    got = np.mean([together(int(rng.integers(1 << 40)), (0,), a, b, splits) for _ in range(rounds)])
    assert got >= jaccard.kept(size, both, splits) - 0.03


def test_short_sets_survive_splits(spark, monkeypatch):
    """Four shingles that all rows share: every path of a row goes through nodes of all rows, and shorter sets run out of tokens."""
    monkeypatch.setattr(jaccard, "LEAF", 8)
    base = [f"c{i}" for i in range(8)]
    rows = [(0, " ".join(base))] + [(k, " ".join([*base, f"k{k}"])) for k in range(1, 200)]  # each is 4/5 like the first
    got = jaccard.jaccard_join(frame(spark, rows))
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got.collect()) == classes(rows)


def test_links_at_exactly_the_similarity(spark):
    words = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(30):  # 56 of 70 shingles shared, and other pairs of the same ratio
        own = [f"k{k}x{w}" for w in words]
        rows += [(3 * k, " ".join(own[:67])), (3 * k + 1, " ".join([*own[:60], *own[100:107]])), (3 * k + 2, " ".join([*own[:59], *own[120:127]]))]
    got = jaccard.jaccard_join(frame(spark, rows))
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got.collect()) == classes(rows)


def test_shared_in_ranges_and_slices():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 2**63, 40, np.uint64) // np.uint64(2**57) * np.uint64(2**57 + 11)) for _ in range(30)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
    assert (jaccard._shared(sets) == want).all() and (jaccard._shared(sets, cells=64, tokens=50) == want).all()


def test_jaccard_join_of_odd_rows(odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard.jaccard_join(odd).collect()) == classes(rows)
    assert jaccard.jaccard_join(nothing).count() == 0 and jaccard.keep_one(nothing).count() == 0
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in kept.filter("doc_id in (4, 5, 7)").collect()) == [(4, len(prose(1, 60))), (7, 3), (7, 9)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 102), (None, 5), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def removed(rows, n=suffixes.LENGTH):
    """(doc, bytes, removed, spans, digest) by a table of all strings of n bytes."""
    first, out = {}, []
    key = lambda r: (r[0] is not None, r[0] or 0)
    for d, t in sorted(set(rows), key=key):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - n + 1):
            if first.setdefault(b[s : s + n], (d, t, s)) != (d, t, s):
                gone[s : s + n] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((d, t, (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())))
    by = {(d, t): v for d, t, v in out}
    return Counter((d, *by[d, t]) for d, t in rows)


def found(df):
    out = suffixes.repeats(df).select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256))
    return Counter(tuple(r) for r in out.collect())


@pytest.mark.parametrize("small", [False, True])
def test_suffix_dedup_equals_all_strings(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(suffixes, "GROUP", 2)  # hot groups are dealt out finer, down to strings of one offset
    rng = random.Random(3)
    passages = [prose(i, 25) for i in range(4)]
    rows = []
    for i in range(40):
        parts = [prose(1000 + i * 10 + j, rng.randint(3, 30)) if rng.random() < 0.5 else rng.choice(passages) for j in range(rng.randint(1, 5))]
        rows.append((i, rng.choice(["", "é"]) + " ".join(parts)))
    rows += [(50, "ab" * 400), (51, "a" * 350), (52, rows[3][1]), (53, "x" + rows[3][1][1:]), (54, prose(1, 14)), (55, "漢" * 60)]
    assert found(frame(spark, rows).repartition(3)) == removed(rows)


def test_work_of_a_share_in_small_pieces(monkeypatch):
    """Segments of a text, as in long ones: the same anchors."""
    data = np.frombuffer((prose(3, 300) + "a" * 500 + prose(4, 100)).encode(), np.uint8)
    whole = suffixes.anchors(data)
    monkeypatch.setattr(suffixes, "SEGMENT", 300)
    cut = suffixes.anchors(data)
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True))


def test_suffix_dedup_of_odd_rows(odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.filter("doc_id is null or doc_id <> 4").collect()]
    assert found(odd.filter("doc_id is null or doc_id <> 4")) == removed(rows)
    assert len(set(found(odd.filter("doc_id = 4")))) == 1  # repeated rows are one occurrence
    assert found(nothing) == Counter()
    out = suffixes.without_repeats(odd)
    assert out.columns == odd.columns and out.filter("doc_id = 5").count() == 0


def test_suffix_sort_equals_sorting():
    rng = random.Random(1)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 20))).encode() for _ in range(300)]
    text = np.frombuffer(b"".join(s.ljust(20, b"\0") for s in strings), np.uint8).reshape(-1, 20)
    order, common = suffixes.common_classes(text, np.array([len(s) for s in strings]))
    assert [strings[i] for i in order] == sorted(strings)
    for k in range(1, len(order)):
        a, b = strings[order[k - 1]], strings[order[k]]
        assert common[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    group = np.sort(np.array([rng.randrange(40) for _ in strings]))
    order, common = suffixes.common_classes(text, np.array([len(s) for s in strings]), group)
    assert (group[order] == group).all() and [strings[i] for i in order] == [s for g in range(40) for s in sorted(strings[i] for i in np.flatnonzero(group == g))]
    assert (common[1:] == -1).tolist() == (group[1:] != group[:-1]).tolist()


def test_suffix_sort_survives_colliding_hashes(monkeypatch):
    """A first base under which all strings of a length hash alike."""
    plain = suffixes.Suffixes.__init__

    def weak(self, text, length, salt):
        plain(self, text, length, salt)
        if salt == 0:
            self.hash[:] = 0

    monkeypatch.setattr(suffixes.Suffixes, "__init__", weak)
    strings = [b"abc", b"abd", b"aaa", b"zzz"]
    order, common = suffixes.common_classes(np.frombuffer(b"".join(strings), np.uint8).reshape(-1, 3), np.full(4, 3))
    assert [strings[i] for i in order] == sorted(strings) and common.tolist() == [-1, 1, 2, 0]


def test_rows_of_one_id_are_told_by_64_bits(spark):
    """Without ids, hundreds of texts share one key but for the hash of the text."""
    shared = prose(5, 30)
    rows = [(None, f"{prose(i, 20)} {shared if i % 2 else ''} {prose(i + 5000, 10)}") for i in range(300)]
    got = suffixes.repeats(frame(spark, rows))
    assert dict(got.dtypes)["tie"] == "bigint" and got.count() == 300 and got.filter("n_removed > 0").count() >= 149


def test_mixing_targets():
    assert mixing.targets([100, 100, 100]) == pytest.approx([50, 100, 150])
    assert mixing.targets([10, 1000, 10]) == pytest.approx([30, 960, 30])
    assert mixing.targets([]) == [] and mixing.targets([0, 5]) == pytest.approx([0, 5])


def test_mixing_meets_its_targets(spark):
    rows = [(i, prose(i, 20 + i % 90), None, [None, "a", "b", "B"][min(i % 7, 3)]) for i in range(300)] + [(900, None, None, "b"), (901, "", None, "zero")]
    df = frame(spark, rows)
    documents, spans = mixing.mixture(df)
    got = sorted(((r.id, r.source, r.size, r.source_size, r.target, r.taken) for r in mixing.taken(documents, spans).collect()), key=str)
    assert len(got) == len(rows) and all(0 <= r[5] <= 3 * r[2] for r in got)
    size, took, goal = Counter(), Counter(), {}
    for _, s, n, whole, target, t in got:
        size[s], took[s], goal[s] = size[s] + n, took[s] + t, target
        assert whole == sum(len((r[1] or "").split()) for r in rows if r[3] == s)
    names = sorted((s for s in size if s is not None)) + [None]
    assert [goal[s] for s in names] == pytest.approx(mixing.targets([size[s] for s in names]))
    assert all(abs(took[s] - goal[s]) <= 0.02 * goal[s] + 2 for s in names)
    again = sorted(((r.id, r.taken) for r in mixing.taken(*mixing.mixture(df.repartition(5))).collect()), key=str)
    assert again == sorted(((r[0], r[5]) for r in got), key=str)
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.split())
        assert set(r.text.split()) <= set(next(x[1] for x in rows if x[0] == r.doc_id).split())
    assert words == Counter({r[0]: r[5] for r in got if r[5]})


def test_mixing_of_odd_rows(odd, nothing):
    got = mixing.taken(*mixing.mixture(odd)).collect()
    assert len(got) == odd.count() and all(r.taken <= 3 * r.size for r in got)
    assert mixing.taken(*mixing.mixture(nothing)).count() == 0 and mixing.mixed_documents(nothing).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_permutation(n):
    assert sorted(mixing.permuted(np.arange(n), n, 11).tolist()) == list(range(n))


LANGUAGES = {"aa": "kala mela sula tora".split(), "bb": "strum krent plack dwoft".split(), "cc": "eauille coeur mentieux lienne".split()}


def spoken(lang, seed, n=40):
    rng = random.Random(seed)
    return " ".join(rng.choice(LANGUAGES[lang]) + rng.choice(LANGUAGES[lang])[:3] for _ in range(n))


def test_language_id_on_held_out_texts(spark):
    rows = [(i, spoken(lang, i), lang) for i in range(240) for lang in [list(LANGUAGES)[i % 3]]]
    df = frame(spark, rows)
    held = langid.held_out(F.col("doc_id"))
    assert {r.doc_id for r in df.filter(held).collect()} == {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    model = langid.train(df.filter(~held))
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 for i, _, lang in rows)
    other = langid.predict(frame(spark, [(1, "qxzj wvvq zzxy " * 9), (2, spoken("bb", 999))]), model)
    assert {r.doc_id: r.rejected for r in other.collect()} == {1: True, 2: False}


def test_letters_are_those_of_the_language():
    for c in map(chr, range(0x3100)):
        assert bool(langid.letter_runs(c)) == c.lower()[0].isalpha()
    assert langid.letter_runs("½ ² Ⅷ _ 7 ٣") == [] and langid.letter_runs("a²b 漢一x") == ["a", "b", "漢一x"]


def test_rare_labels_are_learned_beside_frequent_ones(spark):
    rows = [(i, spoken(lang, i), lang) for i in range(240) for lang in [list(LANGUAGES)[i % 3]]] + [(1000 + i, spoken("aa", i), f"noise {i}") for i in range(20)] + [(2000, "½ ² Ⅷ 12", "aa")]
    df = frame(spark, rows)
    model = langid.train(df)
    got = {r.doc_id: r.lang_pred for r in langid.predict(df, model).collect()}
    assert set(model["languages"]) == {r[2] for r in rows} and got[2000] == "und"
    assert all(got[i] == lang or lang == "aa" and got[i].startswith("noise") for i, _, lang in rows[:240])


def kneser_ney(words, counts, char, before, order=langid.ORDER):
    """P(char | before) by the textbook recursion over strings; ``before`` is padded with starts."""
    padded = Counter()
    for w, n in zip(words, counts):
        padded["^" * (order - 1) + w + "$"] += n
    raw, alphabet = [Counter() for _ in range(order + 1)], {c for w in words for c in w} | {"$"}
    for w, n in padded.items():
        for i in range(order - 1, len(w)):
            raw[order][w[i - order + 1 : i + 1]] += n
    for k in range(order - 1, 0, -1):  # how many different characters a string follows
        for g in raw[k + 1]:
            raw[k][g[1:]] += 1

    def p(k):
        if k == 0:
            return 1 / (len(alphabet) + 1)
        context = before[len(before) - k + 1 :] if k > 1 else ""
        seen = {g: n for g, n in raw[k].items() if g[:-1] == context}
        if not seen:
            return p(k - 1)
        ones, twos = (sum(n == x for n in raw[k].values()) for x in (1, 2))
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        return (max(seen.get(context + char, 0) - d, 0) + d * len(seen) * p(k - 1)) / sum(seen.values())

    return p(order)


def test_kneser_ney_equals_the_recursion():
    words, counts = ["abba", "baab", "aba", "cab", "bac", "abc"], [3, 1, 2, 2, 1, 5]
    joint = langid.join_tables([langid.fit(words, np.array(counts))])
    for word in ["abba", "cabc", "zab", "b", "aaaa", "bacz"]:
        want = sum(math.log2(kneser_ney(words, counts, c, "^" * 3 + word[:i])) for i, c in enumerate(word + "$"))
        assert langid.word_scores([word], joint)[0, 0] == pytest.approx(want, rel=1e-4)


def test_kneser_ney_sums_to_one():
    words = ["abba", "baab", "aba", "cab", "bac"]
    joint = langid.join_tables([langid.fit(words, np.array([3, 1, 2, 2, 1]))])
    for stem in ("", "a", "ab", "zz"):
        total = 0.0
        for c in ["a", "b", "c", None]:
            word = stem + (c or "")
            codes = langid._codes([word + "x"] if c else [word], langid.ORDER)
            p = np.full((len(codes[1]), 1), joint["base"])
            grams, contexts = langid._grams(codes[0], codes[1], langid.ORDER), langid._grams(codes[0], codes[1] - 1, langid.ORDER - 1)
            for k, (gram, seen, context, gamma) in enumerate(joint["levels"], 1):
                p = langid._lookup(gram, seen, grams[k]) + langid._lookup(context, gamma, contexts[k - 1]) * p
            total += float(p[len(stem)][0])
        assert total + float(joint["base"][0]) * 0 == pytest.approx(1 - _unknown_share(joint, stem), abs=1e-5)


def _unknown_share(joint, stem):
    """Probability left for a character that was never met."""
    codes = langid._codes([stem + "z"], langid.ORDER)
    p = np.full((len(codes[1]), 1), joint["base"])
    grams, contexts = langid._grams(codes[0], codes[1], langid.ORDER), langid._grams(codes[0], codes[1] - 1, langid.ORDER - 1)
    for k, (gram, seen, context, gamma) in enumerate(joint["levels"], 1):
        p = langid._lookup(gram, seen, grams[k]) + langid._lookup(context, gamma, contexts[k - 1]) * p
    return float(p[len(stem)][0])


def test_language_id_of_odd_rows(odd, nothing):
    model = langid.train(odd)
    got = langid.predict(odd, model).collect()
    assert len(got) == odd.count()
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    empty = langid.train(nothing)
    assert {r.lang_pred for r in langid.predict(odd, empty).collect()} == {"und"} and langid.predict(nothing, model).count() == 0


def split(text):
    return [w.lower() for w in (text or "").encode().split()] + [None]


@pytest.mark.parametrize("small", [False, True])
def test_scores(spark, odd, nothing, small):
    # small: many chunks, merges inside a part, first words with several rooms, limits for many customers
    sizes = scoring.Sizes(chunk=300, pairs=4000, sample=2, exact=20) if small else scoring.Sizes()
    docs = [(i, prose(i % 40, 20 + i % 30) + (" NEW" + str(i) if i % 9 == 0 else "")) for i in range(150)]
    df = frame(spark, docs).select("doc_id", "text").union(odd.select("doc_id", "text")).repartition(3)
    learns = ~scoring.in_fold(F.col("doc_id"))
    counts = Counter(w for r in df.filter(learns).collect() for w in split(r.text))
    n, v = sum(counts.values()), len(counts)
    scored = scoring.score(df, learns, sizes=sizes).collect()
    got = Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in scored)
    want = Counter((r.doc_id, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)) for r in df.collect() for w in [split(r.text)])
    assert got == want
    held = [r for r in scored if r.doc_id is not None and r.doc_id < 150 and zlib.crc32(str(r.doc_id).encode()) % 7 == 2 and r.n_tokens > 3]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    again = scoring.score(df, learns, sizes=sizes).collect()
    assert Counter((r.doc_id, round(r.score, 6)) for r in again) == Counter((r.doc_id, round(r.score, 6)) for r in scored)
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    moved = scoring.score(df, learns, sizes=sizes).collect()
    spark.conf.unset("spark.sql.unionOutputPartitioning")
    assert Counter((r.doc_id, round(r.score, 6)) for r in moved) == Counter((r.doc_id, round(r.score, 6)) for r in scored)
    if not small:
        assert scoring.score(nothing, F.lit(True)).count() == 0
        assert {(r.train_tokens, r.score, r.base_score) for r in scoring.score(odd, F.lit(False)).collect()} == {(0, 0.0, 0.0)}


class Franchise:
    """A Gibbs sampler that seats every customer at a table of its own account, one at a time."""

    def __init__(self, texts, d1, d0, seed):
        self.rng, self.d = random.Random(seed), (d1, d0)
        self.customers = [(p, w) for t in texts for p, w in zip([None, *split(t)], split(t))]
        self.words = len({w for _, w in self.customers})
        self.tables, self.total, self.sizes = defaultdict(list), Counter(), Counter()
        self.seat = {}

    def p(self, c, w):
        """Predictive probability of w in restaurant c; the root is ()."""
        parent = 1 / (self.words + 1) if c == () else self.p((), w)
        t, d = self.tables[c, w], self.d[c == ()]
        return (sum(t) - d * len(t) + (scoring.CONCENTRATION + d * self.total[c]) * parent) / (scoring.CONCENTRATION + self.sizes[c])

    def add(self, c, w):
        t, d = self.tables[c, w], self.d[c == ()]
        parent = 1 / (self.words + 1) if c == () else self.p((), w)
        at = self.rng.choices(range(len(t) + 1), [x - d for x in t] + [(scoring.CONCENTRATION + d * self.total[c]) * parent])[0]
        self.sizes[c] += 1
        if at == len(t):
            t.append(1)
            self.total[c] += 1
            if c != ():
                self.add((), w)
        else:
            t[at] += 1

    def remove(self, c, w):
        t = self.tables[c, w]
        at = self.rng.choices(range(len(t)), t)[0]
        t[at] -= 1
        self.sizes[c] -= 1
        if not t[at]:
            t.pop(at)
            self.total[c] -= 1
            if c != ():
                self.remove((), w)

    def run(self, sweeps, burn_in, texts):
        for p, w in self.customers:
            self.add((p,), w)
        out = [[0.0] * len(split(t)) for t in texts]
        for i in range(sweeps):
            for p, w in self.customers:
                self.remove((p,), w)
                self.add((p,), w)
            if i >= burn_in:
                for t, sums in zip(texts, out):
                    for j, (p, w) in enumerate(zip([None, *split(t)], split(t))):
                        sums[j] += self.p((p,), w) / (sweeps - burn_in)
        return [sum(math.log10(x) for x in sums) for sums in out]


@pytest.mark.parametrize(("sizes", "near"), [(scoring.Sizes(settle=20, sweeps=60, burn_in=20), 0.03), (scoring.Sizes(), 0.06)])
def test_scores_equal_a_sampler_of_single_customers(spark, sizes, near):
    words = [f"w{i}" for i in range(25)]
    rng = random.Random(8)
    texts = [" ".join(rng.choices(words, [1 / (1 + (i * (1 + j % 4)) % 25) for i in range(25)], k=rng.randint(3, 30))) for j in range(60)]
    held = texts[50:] + ["w1 w1 unseen w2", ""]
    cells = Counter((p, w) for t in texts[:50] for p, w in zip([None, *split(t)], split(t)))
    types = Counter(w for _, w in cells)
    d1, d0 = (scoring.discount_of(sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())) for c in (cells, types))
    want = np.mean([Franchise(texts[:50], d1, d0, seed).run(40, 10, held) for seed in range(2)], axis=0)
    rows = [(i, t) for i, t in enumerate(texts[:50])] + [(100 + i, t) for i, t in enumerate(held)]
    got = {r.doc_id: r.score for r in scoring.score(frame(spark, rows), F.col("doc_id") < 100, sizes=sizes).collect()}
    got = [got[100 + i] for i in range(len(held))]
    assert got == pytest.approx(want, rel=2 * near) and sum(got) == pytest.approx(sum(want), rel=near), (sum(got), sum(want), got, want)


def test_slots_fill_each_partition_once(spark):
    for n in (1, 4, 37, 200):
        keys = spark.createDataFrame([(int(k),) for k in scoring.slots(n)], "k int")
        assert keys.select(F.pmod(F.hash("k"), F.lit(n))).distinct().count() == n


def seatings(n, others, weight, d):
    """Probability of each number of tables of a dish, by all ways to seat n customers."""
    out, ways = Counter(), [((1,), (scoring.CONCENTRATION + d * others) * weight)]
    for _ in range(n - 1):
        ways = [x for t, p in ways for x in [((*t, 1), p * (scoring.CONCENTRATION + d * (others + len(t))) * weight), *((t[:i] + (t[i] + 1,) + t[i + 1 :], p * (t[i] - d)) for i in range(len(t)))]]
    for t, p in ways:
        out[len(t)] += p
    return np.array([out[t] for t in range(1, n + 1)]) / sum(out.values())


@pytest.mark.parametrize(("n", "others", "weight", "d"), [(2, 0, 0.5, 0.5), (5, 3, 0.2, 0.7), (7, 50, 0.3, 0.3)])
def test_table_draws_follow_the_conditional(n, others, weight, d):
    got = scoring.draw_tables(n, np.full(40_000, float(others)), np.full(40_000, weight), d, np.random.default_rng(2))
    assert np.bincount(got.astype(int), minlength=n + 1)[1:] / 40_000 == pytest.approx(seatings(n, others, weight, d), abs=0.012)


@pytest.mark.parametrize(("others", "weight", "d"), [(10, 0.01, 0.6), (100, 0.05, 0.6), (2000, 0.001, 0.8), (20000, 0.001, 0.8), (40, 0.3, 0.4)])
def test_the_limit_of_many_customers_is_close(others, weight, d):
    args = np.full(20_000, float(others)), np.full(20_000, weight), d
    exact = scoring.draw_tables(scoring.EXACT, *args, np.random.default_rng(3))
    limit = scoring.draw_many_tables(np.full(20_000, float(scoring.EXACT)), *args, np.random.default_rng(4))
    assert limit.mean() == pytest.approx(exact.mean(), rel=0.07) and limit.std() == pytest.approx(exact.std(), rel=0.2)


def test_predictive_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    place, n = np.repeat(np.arange(5), 8), rng.integers(0, 30, 40)
    seating = scoring.Seating(place, n, np.zeros(5), 0.6, rng)
    guests = np.arange(1, 9)
    tables = scoring.Seating(np.zeros(8, np.int64), guests, np.zeros(1), 0.4, rng).averaged(np.full(8, 1 / 9), 4, 1)
    parent = scoring.root_predictive(guests, tables, guests.sum(), tables.sum(), 8, 0.4)
    unknown = scoring.root_predictive(np.zeros(1), np.zeros(1), guests.sum(), tables.sum(), 8, 0.4)
    assert parent.sum() + unknown[0] == pytest.approx(1)
    mean = seating.averaged(np.tile(parent, 5), 4, 1)
    down = 1 + np.bincount(place, n)
    own, share = (n - 0.6 * mean) / down[place], (1 + 0.6 * np.bincount(place, mean)) / down
    assert np.bincount(place, own) + share == pytest.approx(np.ones(5))


VECTORS = "vec_id long, embedding array<float>, label int, v string, key string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], VECTORS)


def exact_nearest(rows, queries, k, length=8):
    x = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and len(v) == length and all(c is not None and math.isfinite(c) for c in v) and any(v)}
    out = {}
    for q in queries & set(x):
        scored = sorted((-float(neighbours.cosine(x[q][None], x[i][None])[0]), i) for i in x if i != q)
        out[q] = [i for _, i in scored[:k]]
    return out


def nearest(df, **options):
    got = defaultdict(list)
    for r in sorted(neighbours.nearest(df, F.col("vec_id") % 10 == 0, **options).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append(r.vec_id)
        assert r.rank == len(got[r.query_id])
    return dict(got)


def float32(x):
    return np.asarray(x, np.float32).tolist()


def test_neighbours_are_exact_when_all_leaves_are_searched(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float32(rng.normal(size=8))) for i in range(200)]
    rows += [(i, rows[20][1]) for i in range(300, 340)] + [(400, rows[20][1])]  # one vector many times
    rows += [(500, None), (510, [0.0] * 8), (520, [float("nan")] * 8), (530, [1.0, None] + [0.0] * 6), (540, [1.0, 2.0]), (None, rows[0][1]), (550, [float("inf")] * 8)]
    want = exact_nearest(rows, {i for i, _ in rows if i is not None and i % 10 == 0}, 5)
    assert nearest(vectors(spark, rows), search=10**6) == want
    assert nearest(vectors(spark, rows), leaf=8, block=16, trees=3, search=10**6) == want


def test_each_length_of_vectors_is_searched_apart(spark):
    rng = np.random.default_rng(14)
    rows = [(i, float32(rng.normal(size=3 if i % 4 else 8))) for i in range(240)] + [(i, float32(rng.normal(size=5))) for i in range(241, 249)] + [(250, []), (260, [1.0])]
    queries = set(range(0, 240, 10))
    want = exact_nearest(rows, queries, 5) | exact_nearest(rows, queries, 5, 3)
    assert set(want) == queries
    assert nearest(vectors(spark, rows), leaf=8, block=16, trees=3, search=10**6) == want


def test_neighbours_recall(spark):
    rng = np.random.default_rng(6)
    rows = [(i, float32(rng.normal(size=8))) for i in range(1500)]
    want, got = exact_nearest(rows, set(range(0, 1500, 10)), 5), nearest(vectors(spark, rows), leaf=32, trees=8, search=500)
    assert np.mean([len(set(want[q]) & set(got[q])) / 5 for q in want]) >= 0.9


def test_ties_of_vectors_of_one_direction(spark):
    """Scaled copies, by powers of two so that their cosines are equal to the last bit."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=8)
    rows = [(i, float32(base * 2.0 ** (i % 7))) for i in range(0, 300)] + [(i, float32(rng.normal(size=8))) for i in range(300, 340)]
    rng.shuffle(rows)
    want = exact_nearest(rows, {i for i, _ in rows if i % 10 == 0}, 5)
    assert nearest(vectors(spark, rows), block=16, leaf=8, trees=3, search=10**6) == want == nearest(vectors(spark, rows), search=10**6)


def test_searches_are_as_wide_as_the_sample_needs(spark):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(60, 8))
    near = centres[rng.integers(0, 60, 1500)] + 0.02 * rng.normal(size=(1500, 8))
    spread = rng.normal(size=(1500, 8))
    wide, narrow = (neighbours.needed(neighbours.fit(x, 8, 32), x, 5) for x in (spread, near))
    assert narrow < wide
    rows = [(i, float32(v)) for i, v in enumerate(near)]
    want, got = exact_nearest(rows, set(range(0, 1500, 10)), 5), nearest(vectors(spark, rows), leaf=32, trees=8)
    assert np.mean([len(set(want[q]) & set(got[q])) / 5 for q in want]) >= 0.9


def test_neighbours_of_few_rows(spark):
    assert nearest(vectors(spark, [])) == {}
    assert nearest(vectors(spark, [(10, float32([1] * 8))])) == {}
    assert nearest(vectors(spark, [(10, float32([1] * 8)), (11, float32(range(8)))])) == {10: [11]}
