"""Operator 2: harmonic packing of tokenised documents into fixed-capacity sequences.

A length in ``(capacity/(k+1), capacity/k]`` is of class k, and a bin of class k takes k pieces,
so each worker fills its bins alone, without seeing any other's lengths. Documents may be cut, so
they are cut where classes waste nothing: whole sequences first, then powers of two down to
``finest``; only the rest, under ``finest`` tokens, is of a class that may leave a gap. What a
worker has left in open bins (less than one bin a class) is joined, cut at the capacity, and its
last part is cut into powers of two, which need no padding.

Defined results: null text counts as empty (one closing token). Repeated rows and null ids are
packed as rows of their own. No document is dropped and no length is capped. No shuffle; a lost
task is redone from its input split with the same sequence ids. Ids are those of the tokenizer file, so
the string of a special token in a text is that token.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, map_rows, quoted

CAPACITY, FINEST, CLOSING = 1024, 64, 0
RUN = 20_000
_RUN = re.compile(r"\s{%d}" % RUN)
_ENCODERS: dict[int, Callable[[str], list[int]]] = {}


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level BPE files use for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(tokenizer_json: str) -> Callable[[str], list[int]]:
    """text -> ids of a byte-level BPE tokenizer file.

    A text with a very long run of white space, on which the fast encoder's pattern runs out of stack,
    is encoded by the tokenizer itself; the ids are the same.
    """
    key = hash(tokenizer_json)
    if key not in _ENCODERS:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.loads(tokenizer_json)
        back, special = byte_alphabet(), {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(back[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
        fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        exact: list[Tokenizer] = []

        def encode(text: str) -> list[int]:
            if len(text) < RUN or not _RUN.search(text):
                return fast.encode(text, allowed_special="all")
            if not exact:
                exact.append(Tokenizer.from_str(tokenizer_json))
            return exact[0].encode(text, add_special_tokens=False).ids

        _ENCODERS[key] = encode
    return _ENCODERS[key]


def cuts(n: int, capacity: int = CAPACITY, finest: int = FINEST) -> Iterator[int]:
    """Lengths of the pieces of a document of n tokens."""
    yield from [capacity] * (n // capacity)
    rest, power = n % capacity, capacity // 2
    while power >= finest:
        if rest >= power:
            yield power
            rest -= power
        power //= 2
    if rest:
        yield rest


class Harmonic:
    """Bins of one worker. Pieces are (doc, start, ids, doc_tokens); rows add (sequence, offset)."""

    def __init__(self, first: int, capacity: int = CAPACITY):
        self.next, self.capacity, self.open = first, capacity, {}

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for doc, start, ids, total in pieces:
            yield doc, start, len(ids), ids.tobytes(), total, self.next, at
            at += len(ids)
        self.next += 1

    def add(self, piece: tuple) -> Iterator[tuple]:
        k = self.capacity // len(piece[2])
        held = self.open.setdefault(k, [])
        held.append(piece)
        if len(held) == k:
            yield from self._close(self.open.pop(k))

    def finish(self) -> Iterator[tuple]:
        room, held = self.capacity, []
        left = sum(len(p[2]) for ps in self.open.values() for p in ps)
        for _, pieces in sorted(self.open.items()):
            for doc, start, ids, total in pieces:
                while len(ids):
                    if room == self.capacity and left < self.capacity:
                        room = 1 << (left.bit_length() - 1)  # a power of two needs no padding
                    part, ids = ids[:room], ids[room:]
                    held.append((doc, start, part, total))
                    start, room, left = start + len(part), room - len(part), left - len(part)
                    if not room:
                        yield from self._close(held)
                        room, held = self.capacity, []
        self.open = {}


def pack(df: DataFrame, tokenizer_json: str, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, finest: int = FINEST, closing: int = CLOSING) -> DataFrame:
    """One row per piece: id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset."""
    vocabulary = df.sparkSession.sparkContext.broadcast(tokenizer_json)  # bounded: a tokenizer file

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        encode = encoder(vocabulary.value)
        bins = Harmonic(TaskContext.get().partitionId() << 40, capacity)
        for doc, data in rows:
            ids = np.array(encode(data.decode()) + [closing], "<u4")
            start = 0
            for n in cuts(len(ids), capacity, finest):
                yield from bins.add((doc, start, ids[start : start + n], len(ids)))
                start += n
        yield from bins.finish()

    rows = df.select(F.col(quoted(id)).alias("doc"), as_bytes(quoted(text)).alias("data"))
    kind = rows.schema["doc"].dataType.simpleString()
    schema = f"{quoted(id)} {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return map_rows(rows, run, schema, size=lambda r: len(r[3]))
