"""Operator 7: mix sources to target weights.

The words of a source, documents one after another, form a stream that is cut into fixed-length
blocks. Output shards get source counts by multinomial draws from what each source has left of its
quota, so totals meet the targets while shards vary. Slot j of a source maps to a pass and, by a
Feistel permutation keyed by source and pass, to a block index; slots and blocks join by index.

Sources sort by code point, null last, and weigh by ``weights``, repeating. Their targets share
all words; none goes over ``most`` times its source, the excess is shared again by weight.

Defined results: null or empty text has no words, so none are taken. Repeated rows are rows of
their own; order in a stream is (bucket, id, hash of the text). All draws are keyed by ``seed``.
The driver holds one row a source and shards x sources counts, never rows of documents. Sources
are broadcast only up to ``BROADCAST_SOURCES``; beyond that they are joined by shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, map_rows, mix, quoted, row_key, saved

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, MOST, BLOCK, SHARDS, SEED = (1, 2, 3), 3, 64, 256, 7
ROWS_A_BUCKET, SLOTS_A_ROW, BROADCAST_SOURCES = 20_000, 1 << 16, 10_000


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> list[float]:
    """Words each source should give; sizes are in source order."""
    w = np.array([weights[i % len(weights)] for i in range(len(sizes))], float)
    cap = most * np.array(sizes, float)
    out, free = np.zeros(len(sizes)), np.ones(len(sizes), bool)
    left = float(sum(sizes))
    while free.any():
        share = np.where(free, left * w / w[free].sum(), 0.0)
        over = free & (share > cap)
        if not over.any():
            out[free] = share[free]
            break
        out[over] = cap[over]
        left -= cap[over].sum()
        free &= ~over
    return out.tolist()


def draw(quota: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Counts by shard and source: multinomial on what is left of each quota, which it never exceeds."""
    left, rows = quota.astype(np.int64).copy(), []
    for k in range(shards):
        rng = np.random.default_rng((seed, k))
        n, row = int(left.sum()) // (shards - k), np.zeros_like(left)
        while n:
            got = np.minimum(rng.multinomial(n, left / left.sum()), left)
            row, left, n = row + got, left - got, n - int(got.sum())
        rows.append(row)
    return np.array(rows)


def permuted(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(n) at x: four Feistel rounds, walked until inside n."""
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask, out, todo = U64((1 << half) - 1), x.astype(U64).copy(), np.arange(len(x))
    while len(todo):
        a, b = out[todo] >> U64(half), out[todo] & mask
        for r in range(4):
            a, b = b, a ^ (mix(b + U64((key * 4 + r) % (1 << 62))) & mask)
        out[todo] = (a << U64(half)) | b
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def mixture(df: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, shards: int = SHARDS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(documents, spans).

    documents: id, tie, source, size, source_size, target, source_no, start (in its source's stream).
    spans: source_no, start, shard, slot, pass, first_word, n_words: what each slot takes of a document.
    """
    spark = df.sparkSession
    sized = saved(df.select(F.col(quoted(id)).alias("id"), F.xxhash64(quoted(text)).alias("tie"), F.col(quoted(source)).alias("source"), F.coalesce(F.regexp_count(quoted(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sized")
    totals = sorted(((r["source"], r["words"], r["n"]) for r in sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n")).collect()), key=lambda r: (r[0] is None, r[0] or ""))
    target = targets([t[1] for t in totals])
    plan, quota = [], []
    for no, ((name, words, _), goal) in enumerate(zip(totals, target, strict=True)):
        length = max(1, min(block, -(-words // 256)))  # a small source is cut finer, to come near its target
        n_blocks = -(-words // length)
        passes = int(goal // words) if words else 0
        quota.append(passes * n_blocks + round((goal - passes * words) / length) if words else 0)
        quota[-1] = min(quota[-1], MOST * n_blocks)
        plan.append((no, name, words, float(goal), length, n_blocks))
    sources = spark.createDataFrame(plan, f"source_no int, name {sized.schema['source'].dataType.simpleString()}, source_size long, target double, length int, n_blocks long")
    if len(plan) <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)

    buckets = max(8, sum(t[2] for t in totals) // ROWS_A_BUCKET)
    rows = sized.join(sources, F.col("source").eqNullSafe(F.col("name"))).drop("name").withColumn("bucket", F.pmod(F.xxhash64("id", "tie"), F.lit(buckets)))
    by_bucket = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("words"))
    before = by_bucket.select("source_no", "bucket", (F.sum("words").over(Window.partitionBy("source_no").orderBy("bucket")) - F.col("words")).alias("before"))
    inside = F.sum("size").over(Window.partitionBy("source_no", "bucket").orderBy("id", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    documents = saved(rows.withColumn("inside", inside).join(before, ["source_no", "bucket"]).withColumn("start", F.col("before") + F.col("inside") - F.col("size")).drop("before", "inside", "bucket"), "placed")

    drawn = draw(np.array(quota, np.int64), shards, seed) if quota else np.zeros((0, 0), np.int64)
    first = np.cumsum(drawn, axis=0) - drawn
    shard, no = np.nonzero(drawn)
    blocks = np.array([p[5] for p in plan], np.int64)
    columns = {"source_no": no.astype(np.int32), "shard": shard.astype(np.int32), "first": first[shard, no], "n": drawn[shard, no], "n_blocks": blocks[no] if len(plan) else no}
    counts = spark.createDataFrame(pa.table(columns))
    parts = counts.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(SLOTS_A_ROW).cast("long"))))
    parts = parts.select("source_no", "shard", F.col("first") + F.col("at"), F.least(F.col("n") - F.col("at"), F.lit(SLOTS_A_ROW)), "n_blocks", "at").repartition(max(8, len(no) // 256))

    def expand(rows: Iterator[tuple]) -> Iterator[tuple]:
        for no, shard, start, n, n_blocks, at in rows:
            j = np.arange(start, start + n, dtype=np.int64)
            turn, index = j // n_blocks, j % n_blocks
            for p in range(int(turn[0]), int(turn[-1]) + 1):
                here = turn == p
                index[here] = permuted(index[here], n_blocks, seed * 1_000_003 + no * 31 + p)
            for i in range(n):
                yield no, shard, at + i, int(turn[i]), int(index[i])

    slots = map_rows(parts, expand, "source_no int, shard int, slot long, pass int, block long")
    whole = F.col("start") + F.col("size")
    pieces = documents.filter("size > 0").select("source_no", "start", "size", "length", F.explode(F.sequence(F.floor(F.col("start") / F.col("length")), F.floor((whole - 1) / F.col("length")))).alias("block"))
    low = F.greatest(F.col("block") * F.col("length"), F.col("start"))
    high = F.least((F.col("block") + 1) * F.col("length"), whole)
    pieces = pieces.select("source_no", "start", "block", (low - F.col("start")).alias("first_word"), (high - low).alias("n_words"))
    # both sides grow with the input, though a plan sees a short list of draws behind the slots
    spans = slots.hint("merge").join(pieces, ["source_no", "block"]).select("source_no", "start", "shard", "slot", "pass", "first_word", "n_words")
    return documents, spans


def taken(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """documents with the number of words the mix takes of each, repeats counted."""
    sums = spans.groupBy("source_no", "start").agg(F.sum("n_words").alias("words"))
    some = documents.filter("size > 0").join(sums, ["source_no", "start"], "left").withColumn("taken", F.coalesce("words", F.lit(0).cast("long")))
    none = documents.filter("size = 0").withColumn("words", F.lit(None).cast("long")).withColumn("taken", F.lit(0).cast("long"))
    return some.unionByName(none).drop("words")


def mixed_documents(df: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mixed corpus with df's columns: for each pass that takes words of a document, a row whose text is those words.

    Words stay as they stand in the text, with what separates them; runs that aren't adjacent are
    joined by a line break. Rows repeated in df, alike in id, text and source, share their spans.
    """
    documents, spans = mixture(df, id, text, source, **options)
    runs = spans.groupBy("source_no", "start", "pass").agg(F.sort_array(F.collect_list(F.struct("first_word", "n_words"))).alias("_graphloom_runs"))
    told = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    runs = documents.filter("size > 0").join(runs, ["source_no", "start"]).select(told("id").alias("_graphloom_id"), F.col("tie").alias("_graphloom_hash"), told("source").alias("_graphloom_source"), "_graphloom_runs", "pass")
    key = ["_graphloom_id", "_graphloom_hash", "_graphloom_source"]
    once = df.withColumns(row_key(id, text, "_graphloom") | {"_graphloom_source": told(quoted(source))}).dropDuplicates(key)
    joined = once.alias("d").join(runs.alias("r"), key)
    columns = [F.col(f"d.{quoted(c)}") for c in df.columns]
    schema, at = df.schema, df.columns.index(text)

    def cut(batches):
        word = re.compile(rb"[^\x20\x09-\x0D]+")
        for batch in batches:
            texts = []
            for value, spans_ in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                data = value.encode()
                ends = [m.span() for m in word.finditer(data)]
                merged: list[list[int]] = []
                for s in spans_:
                    if merged and merged[-1][1] == s["first_word"]:
                        merged[-1][1] += s["n_words"]
                    else:
                        merged.append([s["first_word"], s["first_word"] + s["n_words"]])
                texts.append(b"\n".join(data[ends[a][0] : ends[b - 1][1]] for a, b in merged).decode())
            arrays = [batch.column(i) for i in range(batch.num_columns - 1)]
            arrays[at] = pa.array(texts, arrays[at].type)
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema])

    return joined.select(*columns, F.col("r._graphloom_runs")).mapInArrow(cut, schema)
