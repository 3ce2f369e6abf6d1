"""Operator 11: cross-tokenizer alignment through a dictionary of groups.

A text is encoded by two tokenizers, A and B, over the same bytes. Offsets at which tokens of both
end cut the text into groups, each a run of A ids and a run of B ids. Equal groups occur again and
again, and so do words, whose groups a task looks up. Groups are interned: a task numbers the distinct ones of a chunk of documents, the groups
of all chunks are merged into one dictionary with their document frequencies, links (all A-B pairs
of a group) are expanded once for each distinct group, and what a group is worth goes back to the
chunks by its key, where documents add it up by number.

How many documents hold a pair linked is the sum of the document frequencies of the groups with
that pair, less what a document counts double that has the pair in several distinct groups; each
task finds those pairs while it has the document's groups at hand.

Defined results: null and empty texts, and texts whose tokens of A or B don't spell the encoded
text, have no tokens: zeros and an empty digest. Strings of special tokens in a text are plain text.
Rows are documents of their own, whatever their ids; an empty table gives no rows. Texts are
encoded whole; a chunk is at least one document. Groups of any size are expanded, by id rather than
by occurrence, a row of A at a time.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, by_group, in_batches, map_rows, quoted, rows_of, saved
from .packing import _RUN, RUN, byte_alphabet

#: A chunk ends at so many tokens of A and B, or distinct words; a task holds the distinct words and groups of a chunk.
CHUNK, WORDS = 8_000_000, 400_000
WIDE = 200_000  # pairs of distinct ids from which a group isn't expanded as one array
_SIDES: dict[int, "Side"] = {}
SHIFT, LOW = np.int64(32), np.int64(0xFFFFFFFF)


class Side:
    """A tokenizer: ``encode(text)`` gives ids, ``bytes_of[id]`` what a token spells, ``sizes`` their lengths.

    ``by_words``: no token holds a space behind something else, so a text may be cut before a space
    that follows no white space, and each part be encoded alone.
    """

    def __init__(self, encode: Callable[[str], list[int]], bytes_of: list[bytes], by_words: bool):
        self.encode, self.bytes_of, self.by_words = encode, bytes_of, by_words
        self.sizes = np.array([len(b) for b in bytes_of], np.int64)


def byte_level(tokenizer_json: str) -> Side:
    """A byte-level BPE file; special tokens are plain text.

    Very long runs of white space go to the slower encoder, since the fast one runs out of stack on
    them; ids are the same.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    spec, back = json.loads(tokenizer_json), byte_alphabet()
    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(back[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
    fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    exact: list[Tokenizer] = []

    def encode(text: str) -> list[int]:
        if len(text) < RUN or not _RUN.search(text):
            return fast.encode_ordinary(text)
        if not exact:
            exact.append(Tokenizer.from_str(tokenizer_json))
            exact[0].encode_special_tokens = True
        return exact[0].encode(text, add_special_tokens=False).ids

    known = {i: b for b, i in ranks.items()}
    # its pattern puts the space in front of a word and never behind
    by_words = (spec.get("pre_tokenizer") or {}) | {"trim_offsets": None} == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": None, "use_regex": True} and not spec.get("normalizer")
    return Side(encode, [known.get(i, b"") for i in range(max(known) + 1)], by_words)


def pieces(model: bytes) -> Side:
    """A sentencepiece model; it puts the space before the text itself."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor()
    sp.LoadFromSerializedProto(model)
    spelt = [bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.get_piece_size())]
    # pieces hold a space in front alone, and only merges of known pieces are made
    by_words = not any(b" " in b.lstrip(b" ") for b in spelt)
    return Side(lambda text: sp.encode(text, num_threads=1), spelt, by_words)


_CUT = re.compile(r"(?<=[^\s▁]) (?!\Z)")  # the sign that pieces write for a space is one in a text as well
_RAGGED = re.compile(r"[\s▁] |^ | \Z")


def words_of(text: str) -> list[str]:
    """The text, with a space in front, cut before each space that follows no white space and isn't the last character; without the first space of each part."""
    return _CUT.split(text) if _RAGGED.search(text) else text.split(" ")


def _side(make: Callable, source: str | bytes) -> Side:
    key = hash((make.__name__, source))
    if key not in _SIDES:
        _SIDES[key] = make(source)
    return _SIDES[key]


def aligned(data: bytes, a: Side, b: Side) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """A ids, B ids, where each group ends in them, and at which byte, of a text or a part that stands behind a space; None if a tokenizer doesn't spell it."""
    whole = b" " + data
    text = data.decode()
    x, y = a.encode(" " + text), b.encode(text)
    if b"".join(map(a.bytes_of.__getitem__, x)) != whole or b"".join(map(b.bytes_of.__getitem__, y)) != whole:
        return None
    x, y = np.array(x, np.int64), np.array(y, np.int64)
    at_x, at_y = np.cumsum(a.sizes[x]), np.cumsum(b.sizes[y])
    # how many tokens of A, and of B, end at or before each byte that both end at; tokens without bytes join the one before
    ends_x, ends_y = np.zeros(len(whole) + 1, np.int32), np.zeros(len(whole) + 1, np.int32)
    ends_x[at_x], ends_y[at_y] = np.arange(1, len(x) + 1), np.arange(1, len(y) + 1)
    both = np.flatnonzero((ends_x > 0) & (ends_y > 0))
    return x, y, ends_x[both].astype(np.int64), ends_y[both].astype(np.int64), both


def group_key(x: np.ndarray, y: np.ndarray) -> bytes:
    return np.concatenate([[len(x)], x, y]).astype("<u4").tobytes()


def group_ids(key: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(key, "<u4").astype(np.int64)
    return ids[1 : 1 + ids[0]], ids[1 + ids[0] :]


def shown(key: bytes) -> str:
    x, y = group_ids(key)
    return ",".join(map(str, x.tolist())) + "|" + ",".join(map(str, y.tolist()))


def links_of(key: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each distinct A id of a group: the distinct B ids, and how many links of the group are of that pair."""
    x, y = group_ids(key)
    (xs, n), (ys, m) = np.unique(x, return_counts=True), np.unique(y, return_counts=True)
    for i, k in zip(xs.tolist(), n.tolist()):
        yield i, ys, m * k


class Groups(dict):
    """The dictionary of a chunk: group key (an integer for one A and one B id, else bytes) -> number."""

    def __init__(self):
        super().__init__()
        self.shown: list[str] = []
        self.links: list[int] = []
        self.pairs: list[np.ndarray | None] = []  # distinct pairs as a << 32 | b; None for a wide group
        self.documents: list[int] = []

    def __missing__(self, key: int | bytes) -> int:
        number = self[key] = len(self.shown)
        if isinstance(key, int):
            self.shown.append(f"{key >> 32}|{key & 0xFFFFFFFF}")
            self.links.append(1)
            self.pairs.append(np.array([key], np.int64))
        else:
            x, y = group_ids(key)
            xs, ys = np.unique(x), np.unique(y)
            self.shown.append(shown(key))
            self.links.append(len(x) * len(y))
            self.pairs.append(None if len(xs) * len(ys) > WIDE else ((xs[:, None] << SHIFT) | ys[None, :]).ravel())
        self.documents.append(0)
        return number

    def keys_in_order(self) -> Iterator[bytes]:
        for key in self:
            yield key if isinstance(key, bytes) else group_key(np.array([key >> 32]), np.array([key & 0xFFFFFFFF]))


def numbered(x: np.ndarray, y: np.ndarray, ends_x: np.ndarray, ends_y: np.ndarray, groups: Groups) -> np.ndarray:
    """The number of each group of a text, in order."""
    starts_x, starts_y = np.concatenate([[0], ends_x[:-1]]), np.concatenate([[0], ends_y[:-1]])
    single = (ends_x - starts_x == 1) & (ends_y - starts_y == 1)
    out = np.empty(len(ends_x), np.int64)
    pairs = (x[starts_x[single]] << SHIFT) | y[starts_y[single]]
    out[single] = np.fromiter(map(groups.__getitem__, pairs.tolist()), np.int64, len(pairs))
    rest = np.flatnonzero(~single)
    flat_x, flat_y = x.astype("<u4").tobytes(), y.astype("<u4").tobytes()
    sizes = (ends_x - starts_x)[rest].astype("<u4").tobytes()
    bounds = zip((4 * starts_x[rest]).tolist(), (4 * ends_x[rest]).tolist(), (4 * starts_y[rest]).tolist(), (4 * ends_y[rest]).tolist())
    keys = [sizes[4 * i : 4 * i + 4] + flat_x[a:b] + flat_y[c:d] for i, (a, b, c, d) in enumerate(bounds)]  # as group_key gives them
    out[rest] = np.fromiter(map(groups.__getitem__, keys), np.int64, len(keys))
    return out


class Words(dict):
    """word -> place in the lists of what a word of the chunk's texts is: groups by number, tokens, and its groups as shown."""

    def __init__(self, a: Side, b: Side, groups: Groups):
        super().__init__()
        self.a, self.b, self.groups = a, b, groups
        self.numbers: list[list[int]] = []
        self.n_a: list[int] = []
        self.n_b: list[int] = []
        self.shown: list[str] = []
        self.misspelt: set[int] = set()

    def _learn(self, words: list[str]) -> None:
        """New words, encoded as one text; it is cut before each of them as the text they come from is."""
        found = aligned(" ".join(words).encode(), self.a, self.b)
        if found is None and len(words) > 1:  # one of them isn't spelt
            for word in words:
                self._learn([word])
            return
        if found is None:
            self.misspelt.add(len(self.numbers))
            self._add(words[0], [], 0, 0)
            return
        x, y, ends_x, ends_y, ends = found
        numbers, shown = numbered(x, y, ends_x, ends_y, self.groups).tolist(), self.groups.shown
        last = np.searchsorted(ends, np.cumsum([len(w.encode()) + 1 for w in words]))
        at = at_x = at_y = 0
        for word, to, to_x, to_y in zip(words, (last + 1).tolist(), ends_x[last].tolist(), ends_y[last].tolist()):
            self._add(word, numbers[at:to], to_x - at_x, to_y - at_y)
            at, at_x, at_y = to, to_x, to_y

    def _add(self, word: str, numbers: list[int], n_a: int, n_b: int) -> None:
        self[word] = len(self.numbers)
        self.numbers.append(numbers)
        self.n_a.append(n_a)
        self.n_b.append(n_b)
        self.shown.append(";".join([self.groups.shown[g] for g in numbers]))

    def text(self, text: str) -> tuple[int, int, np.ndarray, str] | None:
        """Tokens of A, of B, the number of each group, and the groups as shown; None if a tokenizer doesn't spell the text."""
        words = words_of(text) if self.a.by_words and self.b.by_words else [text]
        new = [w for w in dict.fromkeys(words[:-1]) if w not in self]
        if words[-1] not in self and words[-1] not in new:
            new.append(words[-1])  # it alone may end in white space, so it goes last
        if new:
            self._learn(new)
        places = list(map(self.__getitem__, words))
        if self.misspelt and not self.misspelt.isdisjoint(places):
            return None
        numbers = np.fromiter(itertools.chain.from_iterable(map(self.numbers.__getitem__, places)), np.int64)
        return sum(map(self.n_a.__getitem__, places)), sum(map(self.n_b.__getitem__, places)), numbers, ";".join(map(self.shown.__getitem__, places))


def counted_again(distinct: np.ndarray, groups: Groups, keys: Callable[[int], bytes], add: Callable[[int, int], None]) -> None:
    """add(pair, k - 1) for each pair that k > 1 of a document's distinct groups have."""
    arrays = [groups.pairs[g] for g in distinct.tolist()]
    if all(p is not None for p in arrays) and sum(map(len, arrays)) < 4_000_000:
        found, n = np.unique(np.concatenate(arrays), return_counts=True)
        for pair, k in zip(found[n > 1].tolist(), (n[n > 1] - 1).tolist()):
            add(pair, k)
        return
    # a row of A at a time
    of: dict[int, list[np.ndarray]] = {}
    for g in distinct.tolist():
        for i, ys, _ in links_of(keys(g)):
            of.setdefault(i, []).append(ys)
    for i, several in of.items():
        found, n = np.unique(np.concatenate(several), return_counts=True)
        for j, k in zip(found[n > 1].tolist(), (n[n > 1] - 1).tolist()):
            add(i << 32 | j, k)


DOC, GROUP, AGAIN = 0, 1, 2
ENCODED = (
    "kind int, chunk long, id {id}, n_a long, n_b long, n_groups long, n_links long, sha string, numbers binary, times binary, "
    "number int, key binary, n long, a int, b int"
)


def encoded(df: DataFrame, tokenizer_json: str, model: bytes, id: str, text: str, chunk: int) -> DataFrame:
    """Rows of three kinds: documents with the numbers of their distinct groups, groups of a chunk, pairs counted double in a chunk."""
    sources = df.sparkSession.sparkContext.broadcast((tokenizer_json, model))  # bounded: two tokenizer files

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        a, b = _side(byte_level, sources.value[0]), _side(pieces, sources.value[1])
        place, volume, groups, again = TaskContext.get().partitionId() << 32, 0, Groups(), Counter()
        words = Words(a, b, groups)
        order: list[bytes] = []

        def key(number: int) -> bytes:
            if len(order) < len(groups):
                order[:] = groups.keys_in_order()
            return order[number]

        def count(pair: int, k: int) -> None:
            again[pair] += k

        def closed() -> Iterator[tuple]:
            for number, (k, n) in enumerate(zip(groups.keys_in_order(), groups.documents)):
                if n:  # words of texts that aren't spelt have groups that no document counts
                    yield GROUP, place, None, None, None, None, None, None, None, None, number, k, n, None, None
            for pair, n in again.items():
                yield AGAIN, place, None, None, None, None, None, None, None, None, None, None, n, pair >> 32, pair & 0xFFFFFFFF

        for doc, data in rows:
            found = words.text(data.decode()) if data else None
            if found is None:
                yield DOC, place, doc, 0, 0, 0, 0, "", b"", b"", None, None, None, None, None
                continue
            n_a, n_b, numbers, shown_ = found
            distinct, times = np.unique(numbers, return_counts=True)
            for g in distinct.tolist():
                groups.documents[g] += 1
            counted_again(distinct, groups, key, count)
            n_links = sum(groups.links[g] * t for g, t in zip(distinct.tolist(), times.tolist()))
            yield DOC, place, doc, n_a, n_b, len(numbers), n_links, hashlib.sha256(shown_.encode()).hexdigest(), distinct.astype("<u4").tobytes(), times.astype("<u4").tobytes(), None, None, None, None, None
            volume += n_a + n_b
            if volume >= chunk or len(words) >= WORDS:
                yield from closed()
                place, volume, groups, again = place + 1, 0, Groups(), Counter()
                words = Words(a, b, groups)
                order.clear()
        yield from closed()

    rows = df.select(F.col(quoted(id)).alias("doc"), as_bytes(quoted(text)).alias("data"))
    return map_rows(rows, run, ENCODED.format(id=rows.schema["doc"].dataType.simpleString()), size=lambda r: 64 + len(r[8] or b"") + len(r[9] or b"") + len(r[11] or b""))


def expanded(groups: DataFrame) -> DataFrame:
    """group, a, b, times (links of that pair in the group), n: the links of each distinct group (group, key, n)."""
    schema = pa.schema([("group", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("times", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for group, key, n in rows_of(batches, "group", "key", "n"):
                for i, ys, m in links_of(key):
                    for j, times in zip(ys.tolist(), m.tolist()):
                        yield group, i, j, times, n

        yield from in_batches(rows(), schema)

    return groups.select("group", "key", "n").mapInArrow(run, "group long, a int, b int, times long, n long")


def pair_counts(links: DataFrame, again: DataFrame) -> DataFrame:
    """a, b, documents (that hold the pair linked), best (no pair of this A id has more), groups (with the pair)."""
    every = links.select("a", "b", "n", F.lit(1).alias("groups")).unionByName(again.select("a", "b", (-F.col("n")).alias("n"), F.lit(0).alias("groups")))
    pairs = saved(every.groupBy("a", "b").agg(F.sum("n").alias("documents"), F.sum("groups").alias("groups")), "pairs")
    most = pairs.groupBy("a").agg(F.max("documents").alias("most"))  # at most a row an id of A: bounded by its vocabulary
    return pairs.join(F.broadcast(most), "a").select("a", "b", "documents", (F.col("documents") == F.col("most")).alias("best"), "groups")


def _added_up(docs: pa.Table, values: pa.Table) -> pa.Table:
    """Documents of a chunk with what their groups are worth, found by number."""
    at = values.column("number").to_numpy()
    worth = np.zeros((at.max(initial=-1) + 1, 2), np.int64)
    worth[at, 0], worth[at, 1] = values.column("best").to_numpy(), values.column("count_sum").to_numpy()
    best, total = [], []
    for numbers, times in zip(docs.column("numbers").to_pylist(), docs.column("times").to_pylist()):
        sums = np.frombuffer(times, "<u4").astype(np.int64) @ worth[np.frombuffer(numbers, "<u4").astype(np.int64)]
        best.append(int(sums[0]))
        total.append(int(sums[1]))
    kept = docs.select(["id", "n_a", "n_b", "n_groups", "n_links", "sha"])
    return kept.append_column("n_best", pa.array(best, pa.int64())).append_column("count_sum", pa.array(total, pa.int64()))


def align(df: DataFrame, tokenizer_json: str, model: bytes, id: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), the dictionary of groups (group, key, n), and the pairs (a, b, documents, best)."""
    rows = saved(encoded(df, tokenizer_json, model, id, text, chunk), "encoded")
    local = rows.filter(F.col("kind") == GROUP).select("chunk", "number", "key", "n")
    groups = saved(local.groupBy("key").agg(F.sum("n").alias("n")).withColumn("group", F.monotonically_increasing_id()), "groups")
    links = saved(expanded(groups), "links")
    pairs = saved(pair_counts(links, rows.filter(F.col("kind") == AGAIN)), "counts")
    known = by_group(links.select("group", "a", "b", "times"), pairs, ["a", "b"], "groups")
    values = known.groupBy("group").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("best"), F.sum(F.col("times") * F.col("documents")).alias("count_sum"))
    told = local.select("chunk", "number", "key").join(groups.select("group", "key").join(values, "group"), "key").select(F.col("chunk").alias("of_chunk"), "number", "best", "count_sum")
    documents = rows.filter(F.col("kind") == DOC).select("chunk", "id", "n_a", "n_b", "n_groups", "n_links", "sha", "numbers", "times")
    kind = rows.schema["id"].dataType.simpleString()
    summed = documents.groupBy("chunk").cogroup(told.groupBy("of_chunk")).applyInArrow(_added_up, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, sha string, n_best long, count_sum long")
    out = summed.select(F.col("id").alias(id), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("sha").alias("groups_sha256"))
    return out, groups, pairs.drop("groups")
