"""Operator 4: language identification by interpolated Kneser-Ney character models.

One model a language over the letters of lower-cased words; n-grams up to ``ORDER`` don't cross
words, so a word's log-probability is a sum that frequent words need only once. The models are
sorted hash arrays (n-gram -> discounted probability, context -> back-off weight, a column a
language), searched by bisection once for all languages. A text gets the language of lowest cross-entropy a symbol (letters and word ends).

Fitting takes a documented bounded sample: about ``SAMPLE_DOCS`` labelled documents a language and
``SAMPLE_TOTAL`` in all, but ``LEAST_DOCS`` a language however many there are, chosen by a hash of id and
text; all their words count. A fifth of it calibrates: the temperature of the confidence, and the cross-entropy
above which a prediction is flagged as rejected. Prediction covers every whole text.

Defined results: null text, empty text and text without a letter give ``und``, score 0. Null or
rare labels are not learned (a null) or learned from what there is; a letter is what ``str.isalpha`` says. Without any labelled document
every row is ``und``. Ties go to the first language by code point. Rows are predicted one by one.
"""

from __future__ import annotations

import re
import sys
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, chunked, map_rows, mix, quoted, saved

ORDER, SAMPLE_DOCS, SAMPLE_TOTAL, LEAST_DOCS, UNDETERMINED = 4, 600, 20_000, 20, "und"
FEW_LANGUAGES = 10_000  # labels whose rates are broadcast; more are joined
CELLS = 4_000_000  # numbers in a worker's cache of token scores
_START, _END = 1, 2
_SCORERS: dict[str, "Scorer"] = {}


_WORDS = re.compile(r"[^\W\d_]+")


@cache
def _letters() -> re.Pattern:
    """Runs of letters: of word characters without digits, "_" and numbers that are no letters."""
    numbers = "".join(c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isalnum() and not c.isalpha())
    return re.compile(rf"[^\W\d_{numbers}]+")


def letter_runs(token: str) -> list[str]:
    runs = _WORDS.findall(token.lower())
    return runs if all(map(str.isalpha, runs)) else _letters().findall(token.lower())


def _codes(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all words, each padded with order-1 starts and one end; positions to predict and their word's number."""
    pad = chr(_START) * (order - 1)
    codes = np.array([ord(c) for w in words for c in f"{pad}{w}{chr(_END)}"], np.uint64)
    lengths = np.array([len(w) + 1 for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), lengths)
    first = np.cumsum(lengths) - lengths
    at = np.arange(lengths.sum()) - first[owner] + (first + (order - 1) * np.arange(1, len(words) + 1))[owner]
    return codes, at, owner


def _grams(codes: np.ndarray, at: np.ndarray, order: int) -> list[np.ndarray]:
    """For k = 0..order: hash of the k codes that end at each position (k = 0: constant)."""
    out = [np.full(len(at), U64(11))]
    for k in range(order):
        out.append(mix(out[-1] * U64(0x2545F4914F6CDD1D) + codes[at - k] + U64(1)))
    return out


def fit(words: list[str], counts: np.ndarray, order: int = ORDER) -> dict:
    """Kneser-Ney tables of one language from its words and their counts."""
    codes, at, owner = _codes(words, order)
    grams, contexts = _grams(codes, at, order), _grams(codes, at - 1, order - 1)
    weight = counts[owner].astype(float)
    levels, rep, n = [], None, None
    for k in range(order, 0, -1):
        if rep is None:
            hashes, rep, inverse = np.unique(grams[k], return_index=True, return_inverse=True)
            n = np.bincount(inverse, weight)
        else:  # number of distinct left extensions
            hashes, inner, inverse = np.unique(grams[k][rep], return_index=True, return_inverse=True)
            n, rep = np.bincount(inverse).astype(float), rep[inner]
        ones, twos = float((n == 1).sum()), float((n == 2).sum())
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        context, which = np.unique(contexts[k - 1][rep], return_inverse=True)
        total, kinds = np.bincount(which, n), np.bincount(which)
        levels.append({"gram": hashes, "p": ((n - discount) / total[which]).astype(np.float32), "context": context, "gamma": (discount * kinds / total).astype(np.float32)})
    return {"levels": levels[::-1], "base": 1.0 / (len(np.unique(codes[at])) + 1)}


def join_tables(models: list[dict]) -> dict:
    """The tables of all languages side by side; a last row holds the value of what isn't there."""

    def side_by_side(keys: list[np.ndarray], values: list[np.ndarray], default: float) -> tuple[np.ndarray, np.ndarray]:
        every = np.unique(np.concatenate(keys))
        table = np.full((len(every) + 1, len(keys)), default, np.float32)
        for m, (k, v) in enumerate(zip(keys, values, strict=True)):
            table[np.searchsorted(every, k), m] = v
        return every, table

    levels = []
    for parts in zip(*(m["levels"] for m in models), strict=True):
        gram, p = side_by_side([x["gram"] for x in parts], [x["p"] for x in parts], 0.0)
        context, gamma = side_by_side([x["context"] for x in parts], [x["gamma"] for x in parts], 1.0)
        levels.append((gram, p, context, gamma))
    return {"base": np.array([m["base"] for m in models], np.float32), "levels": levels}


def _lookup(keys: np.ndarray, table: np.ndarray, x: np.ndarray) -> np.ndarray:
    i = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return table[np.where(keys[i] == x, i, len(keys))]


def word_scores(words: list[str], joint: dict, order: int = ORDER) -> np.ndarray:
    """For each word: log2-probability in each model, then the number of symbols."""
    width = len(joint["base"])
    if not words:
        return np.zeros((0, width + 1))
    codes, at, owner = _codes(words, order)
    grams, contexts = _grams(codes, at, order), _grams(codes, at - 1, order - 1)
    p = np.broadcast_to(joint["base"], (len(at), width))
    for k, (gram, seen, context, gamma) in enumerate(joint["levels"], 1):
        p = _lookup(gram, seen, grams[k]) + _lookup(context, gamma, contexts[k - 1]) * p
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    return np.column_stack([np.add.reduceat(np.log2(p.astype(float)), first, axis=0), np.bincount(owner, minlength=len(words))])


class Scorer:
    """Sums of word scores over texts; keeps the scores of at most ``limit`` tokens."""

    def __init__(self, joint: dict, order: int = ORDER, limit: int = 400_000, longest: int = 48):
        self.width = len(joint["base"]) + 1
        self.joint, self.order, self.limit, self.longest = joint, order, min(limit, max(8_000, CELLS // self.width)), longest
        self.table = np.zeros((limit, self.width), np.float32)
        self.rows: dict[str, int] = {}

    def _token_scores(self, tokens: list[str]) -> np.ndarray:
        runs = [letter_runs(t) for t in tokens]
        owner = np.repeat(np.arange(len(tokens)), [len(r) for r in runs])
        scores = word_scores([r for rs in runs for r in rs], self.joint, self.order)
        return np.column_stack([np.bincount(owner, scores[:, i], len(tokens)) for i in range(self.width)])

    def texts(self, texts: list[str]) -> np.ndarray:
        out, held, n = np.zeros((len(texts), self.width)), [], 0
        for i, text in enumerate(texts):
            for tokens in chunked(text.split(), self.limit // 4):
                held.append((i, tokens))
                n += len(tokens)
                if n >= self.limit // 4:
                    self._add(held, out)
                    held, n = [], 0
        self._add(held, out)
        return out

    def _add(self, held: list[tuple[int, list[str]]], out: np.ndarray) -> None:
        """Adds the scores of at most limit / 2 tokens; those not met before are scored together."""
        missing = list({t for _, tokens in held for t in tokens if t not in self.rows})
        long = [t for t in missing if len(t) > self.longest]  # too long to keep: scored apart, a few at once
        if long:
            kept = [(i, [t for t in tokens if len(t) <= self.longest]) for i, tokens in held]
            for i, tokens in held:
                for part in chunked((t for t in tokens if len(t) > self.longest), 50):
                    out[i] += self._token_scores(part).sum(0)
            held, missing = kept, [t for t in missing if len(t) <= self.longest]
        if len(self.rows) + len(missing) > self.limit:
            self.rows.clear()
            missing = list({t for _, tokens in held for t in tokens})
        start = len(self.rows)
        for part in chunked(missing, 20_000):
            self.table[start : start + len(part)] = self._token_scores(part)
            self.rows.update(zip(part, range(start, start + len(part)), strict=True))
            start += len(part)
        for i, tokens in held:
            if tokens:
                out[i] += self.table[np.fromiter(map(self.rows.__getitem__, tokens), np.int64, len(tokens))].sum(0, dtype=float)


def held_out(id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text modulo folds is 0; a null id counts as empty text."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def train(df: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS, order: int = ORDER) -> dict:
    """{languages, models, limit, temperature, order} from a sample of the rows of df whose label isn't null.

    The driver gets the words of the sample with their counts, and one row a calibration document.
    """
    rows = df.select(F.col(quoted(id)).cast("string").alias("id"), F.col(quoted(text)).alias("text"), F.col(quoted(lang)).cast("string").alias("lang")).filter("lang is not null and text is not null")
    per = saved(rows.groupBy("lang").agg(F.count("*").alias("docs")), "labels")
    languages = sorted(r["lang"] for r in per.select("lang").collect())
    if not languages:
        return {"languages": [], "joint": None, "limit": 0.0, "temperature": 1.0, "order": order, "key": ""}
    sample_docs = max(min(sample_docs, SAMPLE_TOTAL // len(languages)), LEAST_DOCS)
    per = F.broadcast(per) if len(languages) <= FEW_LANGUAGES else per
    drawn = lambda what, n: F.pmod(F.xxhash64("id", "text", F.lit(what)), F.lit(n))
    sample = rows.join(per, "lang").filter(drawn("sample", 1 << 20) / (1 << 20) < sample_docs / F.col("docs")).withColumn("calibrates", drawn("part", 5) == 0)

    def count(rows: Iterator[tuple]) -> Iterator[tuple]:
        from collections import Counter

        seen: Counter = Counter()
        for label, text_ in rows:
            seen.update((label, w) for w in letter_runs(text_))
            if len(seen) > 500_000:
                yield from ((a, b, n) for (a, b), n in seen.items())
                seen.clear()
        yield from ((a, b, n) for (a, b), n in seen.items())

    fitting = map_rows(sample.filter(~F.col("calibrates") | (F.col("docs") < 20)).select("lang", "text"), count, "lang string, word string, n long")
    counted: pa.Table = fitting.groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow().sort_by([("lang", "ascending"), ("word", "ascending")])
    models, kept = [], []
    for language in languages:
        part = counted.filter(pa.compute.equal(counted["lang"], language))
        if part.num_rows:
            models.append(fit(part["word"].to_pylist(), part["n"].to_numpy(), order))
            kept.append(language)
    model = {"languages": kept, "joint": join_tables(models) if kept else None, "limit": float("inf"), "temperature": 1.0, "order": order, "key": uuid.uuid4().hex}
    if not kept:
        return model
    held = predict(sample.filter("calibrates"), model, "id", "text", entropies=True, keep="lang")
    seen = [(kept.index(r["keep"]), np.array(r["entropies"])) for r in held.filter("entropies is not null").collect() if r["keep"] in kept]
    if seen:
        truth, h = np.array([t for t, _ in seen]), np.array([e for _, e in seen])
        model["limit"] = float(np.quantile(h.min(1), 0.999) + 0.5)
        loss = lambda t: -np.log(np.maximum(_softmax(-h * t)[np.arange(len(truth)), truth], 1e-12)).mean()
        model["temperature"] = float(min((2.0**k for k in range(-2, 8)), key=loss))
    return model


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def predict(df: DataFrame, model: dict, id: str = "doc_id", text: str = "text", entropies: bool = False, keep: str | None = None) -> DataFrame:
    """One row per input row: id, lang_pred, score (0 to 1), rejected, entropy (bits a symbol of the language chosen)."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the sample it was fitted on

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        m = shared.value
        if m["languages"] and m["key"] not in _SCORERS:  # one for all tasks of a worker
            _SCORERS.clear()
            _SCORERS[m["key"]] = Scorer(m["joint"], m["order"])
        scorer = _SCORERS.get(m["key"])
        for part in chunked(rows, 256):
            sums = scorer.texts([r[1] or "" for r in part]) if scorer else [(0,)] * len(part)
            for row, s in zip(part, sums, strict=True):
                extra = (row[2],) if keep else ()
                if not m["languages"] or not s[-1]:
                    yield row[0], UNDETERMINED, 0.0, True, None, *((None,) if entropies else ()), *extra
                    continue
                h = -s[:-1] / s[-1]
                best = int(h.argmin())
                yield row[0], m["languages"][best], float(_softmax(-h * m["temperature"])[best]), bool(h[best] > m["limit"]), float(h[best]), *((h.tolist(),) if entropies else ()), *extra

    columns = [F.col(quoted(id)).alias("doc"), F.col(quoted(text)).alias("value"), *([F.col(quoted(keep)).alias("keep")] if keep else [])]
    rows = df.select(*columns)
    kind = rows.schema["doc"].dataType.simpleString()
    schema = f"{quoted(id)} {kind}, lang_pred string, score double, rejected boolean, entropy double" + ", entropies array<double>" * entropies + ", keep string" * bool(keep)
    return map_rows(rows, run, schema)
