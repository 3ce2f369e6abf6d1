"""Operator 10: quality rules as a short-circuit cascade.

Each rule is a predicate that rejects a document. Its cost (seconds a document) and selectivity
(share it rejects) are estimated on a bounded sample, then rules run by rejection per cost, and a
document leaves at the first rule that rejects it. A conjunction doesn't depend on the order, so
the verdict is the same for any sample; only the name of the first failed rule may differ.

Defined results: null or empty text has no words and is rejected by ``few_words``. Ties, repeated
rows and null ids pass through row by row. Texts of any length are measured whole.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, map_rows, quoted, shingle_hashes, word_hashes

WINDOW = 5
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)


class Text:
    """One document's measures, each computed when first asked for."""

    def __init__(self, data: bytes):
        self.data = data

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.data.split(b"\n") if x.strip()]

    @cached_property
    def histogram(self) -> np.ndarray:
        return np.bincount(np.frombuffer(self.data, np.uint8), minlength=256)

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        h = self.histogram
        return int(len(self.data) - h[0x80:0xC0].sum() - h[9:14].sum() - h[32])

    @cached_property
    def n_symbols(self) -> int:
        return int(self.histogram[SYMBOLS].sum())

    @cached_property
    def n_letters(self) -> int:
        """ASCII letters and the first bytes of other characters."""
        h = self.histogram
        return int(h[65:91].sum() + h[97:123].sum() + h[0xC0:].sum())

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        if self.n_words <= WINDOW:
            return 0
        grams = shingle_hashes(word_hashes(self.words), WINDOW)
        order = np.argsort(grams, kind="stable")
        same = grams[order[1:]] == grams[order[:-1]]
        if not same.any():
            return 0
        hit = np.zeros(len(grams), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        edges = np.zeros(self.n_words + 1, np.int64)
        edges[: len(grams)] += hit
        edges[WINDOW : WINDOW + len(grams)] -= hit
        return int((np.cumsum(edges) > 0).sum())


_BULLET = re.compile(rb"^\s*(?:[-*]|\xe2\x80\xa2)")

#: name -> predicate that rejects. The first two are the base of the published contract.
RULES: dict[str, Callable[[Text], bool]] = {
    "few_words": lambda t: t.n_words < 10,
    "repeated_words": lambda t: 100 * t.n_repeat_words > 20 * t.n_words,
    "symbols": lambda t: 10 * t.n_symbols > t.n_words,
    "word_length": lambda t: not 2 * t.n_words <= t.word_chars <= 15 * t.n_words,
    "letters": lambda t: 100 * t.n_letters < 60 * t.word_chars,
    "duplicate_lines": lambda t: len(t.lines) >= 4 and 10 * t.n_dup_lines > 3 * len(t.lines),
    "bullets": lambda t: len(t.lines) >= 4 and 10 * sum(bool(_BULLET.match(x)) for x in t.lines) > 9 * len(t.lines),
    "ellipses": lambda t: len(t.lines) >= 4 and 10 * sum(x.rstrip().endswith((b"...", b"\xe2\x80\xa6")) for x in t.lines) > 3 * len(t.lines),
}
BASE = ("few_words", "repeated_words")


def estimate(df: DataFrame, text: str = "text", rules: dict[str, Callable[[Text], bool]] = RULES, sample_rows: int = 400) -> list[str]:
    """Rule names by rejection per cost, measured on about ``sample_rows`` documents from all over the table.

    Documents are drawn by a hash of the text, copies apart. Every rule is timed on a fresh Text, so that no rule rides on what another has computed. An
    empty table leaves the rules in the order given.
    """

    def timed(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (data,) in rows:
            for name, rejects in rules.items():
                began = time.perf_counter()
                hit = rejects(Text(data))
                yield name, time.perf_counter() - began, int(hit)

    share = min(1.0, sample_rows / max(df.count(), 1))
    draw = F.pmod(F.xxhash64(quoted(text), F.monotonically_increasing_id()), F.lit(1 << 30))
    sample = df.select(as_bytes(quoted(text)).alias("data"), draw.alias("draw")).filter(F.col("draw") < int(share * (1 << 30))).select("data")
    seen = map_rows(sample, timed, "rule string, seconds double, hit int")
    stats = {r["rule"]: (r["s"], r["h"], r["n"]) for r in seen.groupBy("rule").agg(F.sum("seconds").alias("s"), F.sum("hit").alias("h"), F.count("*").alias("n")).collect()}
    gain = lambda name: (stats[name][1] + 0.5) / max(stats[name][0], 1e-9) if name in stats else 0.0
    return sorted(rules, key=lambda name: -gain(name))


def quality(df: DataFrame, id: str = "doc_id", text: str = "text", rules: dict[str, Callable[[Text], bool]] = RULES, order: list[str] | None = None, measures: bool = True) -> DataFrame:
    """One row per input row: id, [n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,] kept, failed_rule.

    Rules run in ``order`` (by default :func:`estimate`'s). With ``measures`` the five counts are
    returned for every document; without, a rejected document costs no more than the rules it met.
    """
    order = order or estimate(df, text, rules)

    def judge(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc, data in rows:
            t = Text(data)
            failed = next((name for name in order if rules[name](t)), None)
            counts = (t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words) if measures else ()
            yield doc, *counts, failed is None, failed

    rows = df.select(F.col(quoted(id)).alias("doc"), as_bytes(quoted(text)).alias("data"))
    kind = rows.schema["doc"].dataType.simpleString()
    counts = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " if measures else ""
    return map_rows(rows, judge, f"{quoted(id)} {kind}, {counts}kept boolean, failed_rule string")


def filter_documents(df: DataFrame, text: str = "text", order: list[str] | None = None) -> DataFrame:
    """The documents that every rule lets pass, all columns as they were."""
    order = order or estimate(df, text)
    schema, at = df.schema, df.columns.index(text)

    def keep(batches):
        import pyarrow as pa

        for batch in batches:
            mask = [(x is not None) and not any(RULES[name](t) for t in (Text(x.encode()),) for name in order) for x in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return df.mapInArrow(keep, schema)
