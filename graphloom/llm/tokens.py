"""Operator 1: token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary pieces that end at each character; dynamic
programming carries the best score and the number of pieces, never the pieces themselves. Ties go
as in the exact tokenizer: a later candidate must be strictly better, and candidates come by
ascending start, so the longest piece wins. A character that no one-character piece covers is an
unknown of score ``least - 10``; runs of unknowns fall back to one piece per UTF-8 byte.

Text is cut before every space (shown as U+2581) as that tokenizer does, so counts add up over
words, and frequent words are counted once. Scores are added in double precision.

Defined results: null or empty text has 0 tokens. Long words are not kept in memory, but counted
whole. Rows, repeated or with null ids, are counted one by one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, quoted

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
_COUNTERS: dict[int, "Counter"] = {}


def rank_vocabulary(pieces: list[str]) -> list[tuple[str, float]]:
    """(piece, score) for pieces by falling frequency: the logarithm of Zipf's law over the ranks.

    The public files hold no unigram model, so scores are derived from the rank of each piece.
    """
    total = math.log(sum(1 / (i + 1) for i in range(len(pieces))))
    return [(p, -math.log(i + 1) - total) for i, p in enumerate(pieces)]


def piece_vocabulary(path: str) -> list[tuple[str, float]]:
    """The vocabulary of a sentencepiece file with byte pieces: unknown first, control pieces left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(sp.get_piece_size()) if not sp.is_control(i) and not sp.is_unknown(i)]
    words = sorted((i for i in ids if not sp.is_byte(i)), key=lambda i: -sp.get_score(i))
    scored = rank_vocabulary([sp.id_to_piece(i) for i in words])
    low = min(s for _, s in scored)
    return [(sp.id_to_piece(sp.unk_id()), low)] + [(sp.id_to_piece(i), low) for i in ids if sp.is_byte(i)] + scored


class Counter(dict):
    """word -> number of pieces. The first vocabulary entry is the unknown piece."""

    def __init__(self, vocabulary: list[tuple[str, float]], limit: int = 400_000, longest: int = 48):
        super().__init__()
        self.limit, self.longest = limit, longest
        self.pieces = {p for p, _ in vocabulary}
        self.unknown, self.unknown_score = vocabulary[0][0], min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score, piece == self.unknown))
        self.automaton.make_automaton()

    def __missing__(self, word: str) -> int:
        n = self.viterbi(word)
        if len(word) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[word] = n
        return n

    def _run(self, text: str) -> int:
        return 1 if text in self.pieces else len(text.encode())

    def viterbi(self, word: str) -> int:
        """Pieces of the best segmentation. State at each end: score, closed pieces, start of a run of unknowns or -1."""
        n = len(word)
        score, count, unknown_from = [0.0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        matches = self.automaton.iter(word)
        end, found = -1, None

        def take(at: int, start: int, s: float, unknown: bool) -> None:
            score[at] = s
            if unknown:
                run = unknown_from[start]
                count[at], unknown_from[at] = count[start], start if run < 0 else run
            else:
                run = unknown_from[start]
                count[at] = count[start] + 1 + (self._run(word[run:start]) if run >= 0 else 0)
                unknown_from[at] = -1

        found = next(matches, None)
        for end in range(n):
            at, best, single, chosen = end + 1, None, False, None
            while found is not None and found[0] == end:
                length, s, unknown = found[1]
                start = at - length
                total = s + score[start]
                if best is None or total > best:
                    best, chosen = total, (start, unknown)
                single = single or length == 1
                found = next(matches, None)
            if not single:
                total = self.unknown_score + score[end]
                if best is None or total > best:
                    best, chosen = total, (end, True)
            take(at, chosen[0], best, chosen[1])
        run = unknown_from[n]
        return count[n] + (self._run(word[run:]) if run >= 0 else 0)

    def tokens(self, text: str) -> int:
        if not text:
            return 0
        shown = text.replace(" ", SPACE)
        words = (shown[1:] if shown[0] == SPACE else shown).split(SPACE)
        return sum(map(self.__getitem__, [SPACE + w for w in words]))


def count_tokens(df: DataFrame, vocabulary: list[tuple[str, float]], id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, n_chars."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)  # bounded: a vocabulary

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        pairs = shared.value
        key = hash(tuple(pairs))
        if key not in _COUNTERS:
            _COUNTERS[key] = Counter(pairs)
        count = _COUNTERS[key].tokens
        for doc, value in rows:
            yield doc, count(value or ""), len(value or "")

    rows = df.select(F.col(quoted(id)).alias("doc"), F.col(quoted(text)).alias("value"))
    kind = rows.schema["doc"].dataType.simpleString()
    return map_rows(rows, run, f"{quoted(id)} {kind}, n_tokens long, n_chars long")
