"""The graph store: tables in, tables out.

A store is five tables and its meta data. Every operation is a plan over them; nothing is held on
the driver and nothing runs graph by graph. Lists of codes are DataFrames or Python lists.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from graphloom.functions import labels
from graphloom.functions.residues import one_hot, with_descriptors

from . import bitmaps, encode, versions
from .lineage import by_slices, cleaned, counted, scratch, settled

TABLES = ("graphs", "node_dict", "edge_dict", "graph_nodes", "graph_edges")
DICTIONARIES = {"node_dict": "node_id", "edge_dict": "edge_id"}
#: Bitmaps of a written collection, what they hold memberships of, and in which dictionary.
BITS = {"node_bits": ("graph_nodes", "node_dict", "node_id"), "edge_bits": ("graph_edges", "edge_dict", "edge_id")}
#: Folders of a written collection: buckets of graphs, ids a folder of a dictionary has at least, and how many such folders are aimed at.
BUCKETS, RANGE, RANGES = 64, 4096, 512
PART = 1 << 17  # graphs and dictionary entries whose bitmaps one task makes
FEW = 10_000  # memberships that a lookup fetches to the driver
NODES = "graph_code string, seq long, pos long, node_label string, coords array<double>, b_factor double"
EDGES = "graph_code string, seq long, pos long, u string, v string, distance double, kinds array<string>"


@dataclass(frozen=True)
class Meta:
    """How a collection was built. Stores merge only if their meta data agree."""

    granularity: str = "CA"
    edge_functions: tuple[tuple[str, str], ...] = ()
    node_metadata: tuple[str, ...] = ()

    def as_json(self) -> str:
        return json.dumps({"granularity": self.granularity, "edge_functions": sorted(self.edge_functions), "node_metadata": sorted(self.node_metadata)}, sort_keys=True)

    def fingerprint(self) -> str:
        return hashlib.sha256(self.as_json().encode()).hexdigest()

    @staticmethod
    def of_json(text: str) -> "Meta":
        d = json.loads(text)
        return Meta(d["granularity"], tuple(map(tuple, d["edge_functions"])), tuple(d["node_metadata"]))


@dataclass(frozen=True)
class GraphStore:
    graphs: DataFrame
    node_dict: DataFrame
    edge_dict: DataFrame
    graph_nodes: DataFrame
    graph_edges: DataFrame
    meta: Meta = field(default_factory=Meta)

    # building -----------------------------------------------------------------------------------

    @staticmethod
    def build(nodes: DataFrame, edges: DataFrame, meta: Meta = Meta(), codes: DataFrame | None = None) -> "GraphStore":
        """Encode a whole collection; codes are upper-cased, repeated rows keep the last by pos.

        A graph that has edges alone is in the catalogue, and so is one that ``codes`` (graph_code, seq) names, with rows or not.
        """
        return GraphStore._encoded(nodes, edges, meta, codes)

    @staticmethod
    def built(nodes: DataFrame, edges: DataFrame, meta: Meta = Meta(), codes: DataFrame | None = None) -> "GraphStore":
        """What ``build`` gives, settled. Tables that were made on the way are removed, so the rows should not be settled inside."""
        with scratch() as keep:
            store = GraphStore.build(nodes, edges, meta, codes)
            return replace(store, **{t: keep(df, t) for t, df in store.tables.items()})

    @staticmethod
    def _encoded(nodes: DataFrame, edges: DataFrame, meta: Meta, codes: DataFrame | None, known: "GraphStore | None" = None, start: dict[str, int] | None = None) -> "GraphStore":
        """What rows add to a store: new graphs, new labels, memberships. ``start``: the next seq and ids."""
        start = start or {"seq": 0, "graph_id": 0, "node_id": 0, "edge_id": 0}
        nodes, edges = encode.upper_codes(nodes), encode.upper_codes(edges)
        named = [nodes, edges] + ([encode.upper_codes(codes)] if codes is not None else [])
        graphs = encode.graph_catalog(*named, start=start["graph_id"]).withColumn("seq", F.col("seq") + start["seq"])
        new_nodes, new_edges = nodes, edges
        if known is not None:
            new_nodes = nodes.join(known.node_dict.select("node_label").hint("merge"), "node_label", "left_anti")
            new_edges = encode.canonical(edges).join(known.edge_dict.select("src_label", "dst_label").hint("merge"), ["src_label", "dst_label"], "left_anti").drop("src_label", "dst_label")
        n = counted(edges)
        node_dict, edge_dict = encode.node_dictionary(new_nodes, meta.granularity, start["node_id"]), encode.edge_dictionary(new_edges, start["edge_id"], n)
        all_nodes = node_dict if known is None else known.node_dict.unionByName(node_dict)
        all_edges = edge_dict if known is None else known.edge_dict.unionByName(edge_dict)
        return GraphStore(graphs, node_dict, edge_dict, encode.graph_nodes(nodes, graphs, all_nodes), encode.graph_edges(edges, graphs, all_edges, n), meta)

    @staticmethod
    def empty(spark: SparkSession, meta: Meta = Meta()) -> "GraphStore":
        return GraphStore.build(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES), meta)

    def settled(self) -> "GraphStore":
        """The same store with its tables written once: for stores that are read more than once."""
        return replace(self, **{t: settled(df, t) for t, df in self.tables.items()})

    def insert(self, nodes: DataFrame, edges: DataFrame, on_duplicate: str = "ignore", meta: Meta | None = None, codes: DataFrame | None = None) -> "GraphStore":
        """Append graphs. ``on_duplicate``: 'ignore' keeps what is stored, 'replace' takes the new, 'error' raises.

        Known labels keep their ids; new ones are appended in first-seen order. Annotations of the
        graphs stay; new graphs have nulls there.
        """
        store = self
        if on_duplicate == "replace":
            store = self.remove(nodes.select("graph_code"), compact=False)
        added = store._added(nodes, edges, on_duplicate, meta, codes, store.next_ids())
        return replace(store, **{t: df.unionByName(added.tables[t], allowMissingColumns=t == "graphs") for t, df in store.tables.items()})

    def _added(self, nodes: DataFrame, edges: DataFrame, on_duplicate: str, meta: Meta | None, codes: DataFrame | None, start: dict[str, int]) -> "GraphStore":
        if meta is not None and meta.fingerprint() != self.meta.fingerprint():
            raise ValueError("the graphs were built with other functions than the store")
        rows = [encode.upper_codes(df) for df in (nodes, edges, codes) if df is not None]
        known = self.graphs.select("graph_code").hint("merge")
        if on_duplicate == "error":
            if any(not df.join(known, "graph_code", "left_semi").isEmpty() for df in rows):
                raise ValueError("graphs are in the store already")
        elif on_duplicate == "ignore":
            rows = [settled(df.join(known, "graph_code", "left_anti"), "added") for df in rows]
        elif on_duplicate != "replace":
            raise ValueError(f"on_duplicate={on_duplicate!r}")
        return GraphStore._encoded(rows[0], rows[1], self.meta, rows[2] if codes is not None else None, self, start)

    def next_ids(self) -> dict[str, int]:
        """The next seq, graph_id, node_id and edge_id."""
        top = {}
        for t, columns in (("graphs", ["seq", "graph_id"]), ("node_dict", ["node_id"]), ("edge_dict", ["edge_id"])):
            row = getattr(self, t).agg(*[F.max(c).alias(c) for c in columns]).first()
            top |= {c: 0 if row[c] is None else int(row[c]) + 1 for c in columns}
        return top

    # reading ------------------------------------------------------------------------------------

    @property
    def tables(self) -> dict[str, DataFrame]:
        return {t: getattr(self, t) for t in TABLES}

    def codes(self) -> DataFrame:
        return self.graphs.orderBy("seq").select("graph_code")

    def _codes(self, codes: DataFrame | str | Iterable[str]) -> DataFrame:
        """(graph_code), distinct and upper-cased."""
        if isinstance(codes, str):
            codes = [codes]
        if not isinstance(codes, DataFrame):
            codes = self.graphs.sparkSession.createDataFrame([(c,) for c in codes], "graph_code string")
        else:
            codes = codes.hint("merge")
        return codes.select(labels.code(F.col(codes.columns[0])).alias("graph_code")).distinct()

    def extract_nodes(self, codes: DataFrame | str | Iterable[str] | None = None, descriptors: bool = False, onehot: bool = False) -> DataFrame:
        """graph_code, node_id, label parts, coords, b_factor [, dim_1..7, one_hot] of one, some or all graphs."""
        out = self._decoded("graph_nodes", "node_dict", codes)
        out = with_descriptors(out) if descriptors else out
        return out.withColumn("one_hot", one_hot(F.col("residue_name"))) if onehot else out

    def extract_edges(self, codes: DataFrame | str | Iterable[str] | None = None) -> DataFrame:
        """graph_code, edge_id, src_label, dst_label, distance, kinds."""
        return self._decoded("graph_edges", "edge_dict", codes)

    def _decoded(self, members: str, dictionary: str, codes: DataFrame | str | Iterable[str] | None, of_graph: tuple[str, ...] = ("graph_code",)) -> DataFrame:
        """Memberships with the code (or other columns) of their graph and their entry. Of all graphs, sides are merged: what is small on disk may be large in memory."""
        rows, entries, id = getattr(self, members), getattr(self, dictionary), DICTIONARIES[dictionary]
        if codes is not None:
            return rows.join(self._chosen(codes).select("graph_id", "graph_code"), "graph_id").join(entries, id)
        n = counted(rows)
        meet = lambda on: lambda a, b: a.join(b.hint("merge"), on)
        named = by_slices(n, [id], "named", meet(id), rows, entries)
        return by_slices(n, ["graph_id"], "decoded", meet("graph_id"), named, self.graphs.select("graph_id", *of_graph))

    def _chosen(self, codes: DataFrame | str | Iterable[str]) -> DataFrame:
        if isinstance(codes, str):
            return self.graphs.filter(F.col("graph_code") == codes.strip().upper())
        return self.graphs.join(self._codes(codes), "graph_code", "left_semi")

    def extract(self, code: str) -> tuple[DataFrame, DataFrame]:
        return self.extract_nodes(code), self.extract_edges(code)

    def extract_many(self, codes: DataFrame | Iterable[str]) -> tuple[DataFrame, DataFrame]:
        return self.extract_nodes(codes), self.extract_edges(codes)

    def raw(self) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) in ingest form: what the store was built from, in canonical orientation."""
        nodes = self._decoded("graph_nodes", "node_dict", None, ("graph_code", "seq")).select("graph_code", "seq", F.col("node_id").alias("pos"), "node_label", "coords", "b_factor")
        edges = self._decoded("graph_edges", "edge_dict", None, ("graph_code", "seq")).select("graph_code", "seq", F.col("edge_id").alias("pos"), F.col("src_label").alias("u"), F.col("dst_label").alias("v"), "distance", "kinds")
        return nodes, edges

    def describe(self) -> DataFrame:
        """part, rows."""
        parts = [df.agg(F.count("*").alias("rows")).select(F.lit(t).alias("part"), "rows") for t, df in self.tables.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def __repr__(self) -> str:
        return f"GraphStore({', '.join(TABLES)}; {self.meta.as_json()})"

    def unpersist(self) -> None:
        for df in self.tables.values():
            df.unpersist()

    # algebra ------------------------------------------------------------------------------------

    def _with_graphs(self, graphs: DataFrame, compact: bool) -> "GraphStore":
        ids = graphs.select("graph_id").hint("merge")
        store = replace(self, graphs=graphs, graph_nodes=self.graph_nodes.join(ids, "graph_id", "left_semi"), graph_edges=self.graph_edges.join(ids, "graph_id", "left_semi"))
        return store.compact() if compact else store

    def compact(self) -> "GraphStore":
        """Ids dense again: graphs by seq, nodes and edges by (first graph that has them, old id); unused entries vanish."""
        graphs = settled(encode.dense(self.graphs.withColumnRenamed("graph_id", "_old"), ["seq", "graph_code"], "graph_id"), "graphs")
        return GraphStore._renumbered([(self, graphs.select(F.col("_old").alias("graph_id"), F.col("graph_id").alias("_graph")))], graphs.select(self.graphs.columns), self.meta)

    @staticmethod
    def _renumbered(parts: list[tuple["GraphStore", DataFrame]], graphs: DataFrame, meta: Meta) -> "GraphStore":
        """A store of the parts' graphs under new ids: each part comes with (graph_id, _graph), old and new, of the graphs it gives.

        Entries of the dictionaries that a surviving graph has are united by their labels, once each, and
        ranked; memberships move by old and new id and never meet a label.
        """

        def again(members: str, dictionary: str, id: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
            moved, used, n = [], [], []
            for at, (store, ids) in enumerate(parts):
                rows = getattr(store, members)
                n.append(counted(rows))
                meet = lambda a, b: a.join(b.hint("merge"), "graph_id").drop("graph_id").withColumnsRenamed({"_graph": "graph_id", id: "_old"})
                here = by_slices(n[at], ["graph_id"], "moved", meet, rows, ids)
                first = lambda a, b: a.join(b.groupBy("_old").agg(F.min("graph_id").alias("_first")).hint("merge"), "_old")
                entries = by_slices(n[at], ["_old"], "entries", first, getattr(store, dictionary).withColumnRenamed(id, "_old"), here)
                moved.append(here)
                used.append(entries.withColumn("_part", F.lit(at)))
            union = reduce(DataFrame.unionByName, used)
            rest = [c for c in union.columns if c not in ("_old", "_first", "_part", *keys)]
            # an entry has one row a part
            unite = lambda df: df.groupBy(*keys).agg(F.min(F.struct("_first", "_old")).alias("_at"), F.collect_list(F.struct("_part", "_old")).alias("_from"), *[F.first(c).alias(c) for c in rest])
            alone = lambda df: df.select(*keys, F.struct("_first", "_old").alias("_at"), F.array(F.struct("_part", "_old")).alias("_from"), *rest)
            one = alone(union) if len(parts) == 1 else by_slices(sum(n), keys, "united", unite, union)
            ranked = settled(encode.dense(one.select("*", F.col("_at._first").alias("_first"), F.col("_at._old").alias("_place")).drop("_at"), ["_first", "_place"], id, n=sum(n)), id)
            new = settled(ranked.select(F.explode("_from").alias("_e"), id).select("_e._part", "_e._old", id), "ids")
            meet = lambda a, b: a.join(b.hint("merge"), "_old").drop("_old")
            out = [by_slices(n[at], ["_old"], members, meet, df, new.filter(F.col("_part") == at).drop("_part")) for at, df in enumerate(moved)]
            columns = getattr(parts[0][0], members).columns
            return reduce(DataFrame.unionByName, out).select(columns), ranked.select(getattr(parts[0][0], dictionary).columns)

        graph_nodes, node_dict = again("graph_nodes", "node_dict", "node_id", ["node_label"])
        graph_edges, edge_dict = again("graph_edges", "edge_dict", "edge_id", ["src_label", "dst_label"])
        return GraphStore(graphs, node_dict, edge_dict, graph_nodes, graph_edges, meta)

    def remove(self, codes: DataFrame | str | Iterable[str], compact: bool = True) -> "GraphStore":
        """The store without some graphs; unknown codes do nothing."""
        return self._with_graphs(self.graphs.join(self._codes(codes), "graph_code", "left_anti"), compact)

    def keep(self, codes: DataFrame | str | Iterable[str], compact: bool = True) -> "GraphStore":
        return self._with_graphs(self.graphs.join(self._codes(codes), "graph_code", "left_semi"), compact)

    def split(self, codes: DataFrame | Iterable[str] | None = None, compact: bool = True) -> tuple["GraphStore", "GraphStore"]:
        """(graphs named, others); without names the first half by insertion order and the rest."""
        if codes is not None:
            return self.keep(codes, compact), self.remove(codes, compact)
        ranked = encode.dense(self.graphs, ["seq", "graph_code"], "_rank")
        half = F.floor(self.graphs.agg(F.count("*").alias("n")).select((F.col("n") / 2).alias("h")).scalar().alias("h"))
        cut = ranked.withColumn("_half", half)
        side = lambda cond: self._with_graphs(cut.filter(cond).select(self.graphs.columns), compact)
        return side("_rank < _half"), side("_rank >= _half")

    @staticmethod
    def merge(stores: list["GraphStore"]) -> "GraphStore":
        """Union by code. Of graphs in several stores the last store's wins, then the list order; the list is left alone.

        Graphs come in the order of insertion, the last store's first. Annotations come along.
        """
        if len({s.meta.fingerprint() for s in stores}) > 1:
            raise ValueError("stores were built with different functions")
        order = [stores[-1], *stores[:-1]]
        shift, every = 0, []
        for at, store in enumerate(order):
            every.append(store.graphs.withColumns({"_part": F.lit(at), "_old": F.col("graph_id"), "seq": F.col("seq") + shift}).drop("graph_id"))
            shift += store.next_ids()["seq"]
        union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), every)
        winner = union.groupBy("graph_code").agg(F.min("_part").alias("_part"))
        graphs = settled(encode.dense(union.join(winner.hint("merge"), ["graph_code", "_part"]), ["seq", "graph_code"], "graph_id"), "graphs")
        ids = lambda at: graphs.filter(F.col("_part") == at).select(F.col("_old").alias("graph_id"), F.col("graph_id").alias("_graph"))
        columns = ["graph_id", *[c for c in graphs.columns if c not in ("graph_id", "_part", "_old")]]
        return GraphStore._renumbered([(store, ids(at)) for at, store in enumerate(order)], graphs.select(columns), stores[-1].meta)

    # persistence --------------------------------------------------------------------------------

    def write(self, path: str, buckets: int = BUCKETS) -> int:
        """The next version of the collection at ``path``, which may be the one this store was read from; its number.

        Memberships are in folders by a bucket of the graph id, dictionaries by ranges of ids, the
        catalogue by a slot of the code, so that one graph reads few files.
        """
        spark = self.graphs.sparkSession
        was = versions.manifest(spark, path)
        start = self.next_ids()
        ranges = {t: max(RANGE, -(-start[id] // RANGES)) for t, id in DICTIONARIES.items()}
        tables = self._folders(path, buckets, ranges, start)
        entry = {"meta": self.meta.as_json(), "buckets": buckets, "ranges": ranges, "next": start, "tables": tables, "batches": {}}
        return versions.commit(spark, path, entry, was["version"] if was else 0)

    def _folders(self, path: str, buckets: int, ranges: dict[str, int], top: dict[str, int]) -> dict[str, dict]:
        """The tables as new folders, as a manifest names them. ``top``: how many ids they have."""
        commit = versions.folder()
        sized = self.graphs
        for t, n in (("graph_nodes", "_n_nodes"), ("graph_edges", "_n_edges")):
            sized = sized.join(getattr(self, t).groupBy("graph_id").agg(F.count("*").alias(n)).hint("merge"), "graph_id", "left").fillna(0, [n])
        slot = F.pmod(F.crc32(F.col("graph_code").cast("binary")), F.lit(buckets)).cast("int")
        cuts = {"graphs": (sized, "slot", slot, "graph_code")}
        cuts |= {t: (getattr(self, t), "range", F.floor(F.col(id) / ranges[t]).cast("int"), id) for t, id in DICTIONARIES.items()}
        bucket = F.pmod("graph_id", F.lit(buckets)).cast("int")
        cuts |= {b: (self._bits(t, id, bucket, buckets, top), "bucket", None, "graph_id") for b, (t, _, id) in BITS.items()}
        cuts |= {t: (getattr(self, t), "bucket", bucket, "graph_id") for t in ("graph_nodes", "graph_edges")}
        out = {}
        for t, (df, name, by, order) in cuts.items():
            # rebalanced, not hashed by folder alone: a large folder is written by several tasks
            cut = df if by is None else df.withColumn(name, by).hint("rebalance", name)
            with cleaned(self.graphs.sparkSession):
                cut.sortWithinPartitions(name, order).write.partitionBy(name).parquet(f"{path}/data/{t}/{commit}", compression="zstd")
            out[t] = {"folders": [commit], "schema": json.loads(cut.select(*[c for c in df.columns if c != name], name).schema.json())}
        return out

    def _bits(self, members: str, id: str, bucket: Column, buckets: int, top: dict[str, int]) -> DataFrame:
        """Bitmaps with their bucket, dealt out by bucket and, in large stores, by further graphs and words. Memberships are shuffled once, bitmaps never."""
        tasks = max(8, (top["graph_id"] + top[id]) // PART)
        parts = -(-tasks // buckets) * 2
        part = F.pmod(F.floor(F.col("graph_id") / buckets) + F.floor(F.col(id) / (bitmaps.WORD << 14)), F.lit(parts))
        dealt = getattr(self, members).select("graph_id", id).withColumns({"bucket": bucket, "_part": part}).repartition(tasks, "bucket", "_part")
        return bitmaps.words(dealt, id, "bucket", "_part", "graph_id").select("graph_id", "word", "bits", "bucket")

    @staticmethod
    def append(spark: SparkSession, path: str, nodes: DataFrame, edges: DataFrame, on_duplicate: str = "ignore", codes: DataFrame | None = None, batch: tuple[str, int] | None = None) -> int:
        """Graphs added to a written collection as its next version; only new rows are written. The version's number.

        ``on_duplicate`` is 'ignore' or 'error'. ``batch`` (name, number) makes a repeated batch do nothing.
        """
        was = versions.manifest(spark, path)
        if batch and was["batches"].get(batch[0], -1) >= batch[1]:
            return was["version"]
        store = Stored.open(spark, path).store
        added = store._added(nodes, edges, on_duplicate, None, codes, was["next"]).settled()
        top = added.next_ids()
        tables = added._folders(path, was["buckets"], was["ranges"], {k: max(0, v - was["next"][k]) for k, v in top.items()})
        for t, new in tables.items():
            old = was["tables"][t]
            tables[t] = {"folders": old["folders"] + new["folders"], "schema": old["schema"]}
        top = {k: max(was["next"][k], v) for k, v in top.items()}
        batches = was["batches"] | ({batch[0]: batch[1]} if batch else {})
        return versions.commit(spark, path, was | {"next": top, "tables": tables, "batches": batches}, was["version"])

    @staticmethod
    def read(spark: SparkSession, path: str, version: int | None = None) -> "GraphStore":
        return Stored.open(spark, path, version).store

    @staticmethod
    def read_graphs(spark: SparkSession, path: str, codes: Iterable[str]) -> "GraphStore":
        return Stored.open(spark, path).graphs(codes)

    def annotate(self, *attributes: Callable[["GraphStore"], DataFrame]) -> "GraphStore":
        """The store with more columns of its graphs: each function makes (graph_id, value columns) from the store; a graph without a row has nulls."""
        graphs = self.graphs
        for f in attributes:
            graphs = graphs.join(f(self).hint("merge"), "graph_id", "left")
        return replace(self, graphs=graphs)

    @staticmethod
    def read_graph(spark: SparkSession, path: str, code: str) -> "GraphStore":
        return Stored.open(spark, path).graphs([code])


@dataclass(frozen=True)
class Stored:
    """A version of a written collection, opened once: graphs are then read without looking at files that don't hold them."""

    store: GraphStore
    entry: dict
    files: dict[str, DataFrame]

    @staticmethod
    def open(spark: SparkSession, path: str, version: int | None = None) -> "Stored":
        entry = versions.manifest(spark, path, version)
        if entry is None:
            raise FileNotFoundError(f"no {'collection' if version is None else f'version {version}'} at {path}")
        files = {t: versions.read(spark, path, t, entry["tables"][t]) for t in (*TABLES, *BITS)}
        plain = {t: files[t].drop("slot", "range", "bucket", "_n_nodes", "_n_edges") for t in TABLES}
        return Stored(GraphStore(**plain, meta=Meta.of_json(entry["meta"])), entry, files)

    def _found(self, codes: Iterable[str]) -> list:
        """Rows of the catalogue, from the folders of these codes."""
        codes = sorted({c.strip().upper() for c in codes})
        slots = sorted({zlib.crc32(c.encode()) % self.entry["buckets"] for c in codes})
        return self.files["graphs"].filter(F.col("slot").isin(slots) & F.col("graph_code").isin(codes)).collect()

    def _members(self, table: str, ids: list[int]) -> DataFrame:
        within = F.col("bucket").isin(sorted({i % self.entry["buckets"] for i in ids})) & F.col("graph_id").isin(ids)
        return self.files[table].filter(within).drop("bucket")

    def _entries(self, dictionary: str, members: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
        """(members, entries): the dictionary's folders that the members' ids are in; few members are fetched, and their ids told to the scan."""
        id, size = DICTIONARIES[dictionary], self.entry["ranges"][dictionary]
        if n <= FEW:
            local = members.toArrow()
            ids = sorted(set(local.column(id).to_pylist()))
            members = members.sparkSession.createDataFrame(local, members.schema)
            folders, known = sorted({i // size for i in ids}), F.col(id).isin(ids)
        else:
            folders, known = sorted(r["_f"] for r in members.select(F.floor(F.col(id) / size).cast("int").alias("_f")).distinct().collect()), F.lit(True)
        return members, self.files[dictionary].filter(F.col("range").isin(folders) & known).drop("range")

    def bits(self, table: str) -> DataFrame:
        """graph_id, word, bits of node_bits or edge_bits."""
        return self.files[table].drop("bucket")

    def structure(self, codes: Iterable[str], table: str = "node_bits") -> DataFrame:
        """graph_code and dictionary entries of some graphs without their attributes, from bitmaps alone."""
        found = self._found(codes)
        _, dictionary, id = BITS[table]
        kept = bitmaps.ids(self._members(table, [r["graph_id"] for r in found]), id)
        kept, entries = self._entries(dictionary, kept, sum(r["_n_nodes" if table == "node_bits" else "_n_edges"] for r in found))
        graphs = self.store.graphs.sparkSession.createDataFrame([(r["graph_id"], r["graph_code"]) for r in found], "graph_id long, graph_code string")
        return kept.join(F.broadcast(graphs), "graph_id").join(entries, id)  # graphs named by a list

    def extract(self, codes: Iterable[str]) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) of some graphs, as GraphStore.extract_many gives them.

        Up to FEW memberships are fetched with their dictionary entries, nodes and edges side by side: five
        small scans and no join. More are left to Spark.
        """
        found = self._found(codes)
        if max(sum(r[n] for r in found) for n in ("_n_nodes", "_n_edges")) > FEW if found else False:
            return self.graphs(codes).extract_many(codes)
        code_of = {r["graph_id"]: r["graph_code"] for r in found}

        def side(members: str, dictionary: str) -> DataFrame:
            id, size = DICTIONARIES[dictionary], self.entry["ranges"][dictionary]
            held = self._members(members, list(code_of))
            rows = held.toArrow()
            ids = rows.column(id).to_numpy()
            known = np.unique(ids).tolist()
            entries = self.files[dictionary].filter(F.col("range").isin(sorted({i // size for i in known})) & F.col(id).isin(known)).drop("range")
            named = entries.toArrow().sort_by(id)
            place = pa.array(np.searchsorted(named.column(id).to_numpy(), ids))
            out = rows.append_column("graph_code", pa.array([code_of[g] for g in rows.column("graph_id").to_pylist()], pa.string()))
            for c in named.column_names:
                if c != id:
                    out = out.append_column(c, named.column(c).take(place))
            types = {f.name: f for f in [*held.schema, *entries.schema]} | {"graph_code": StructField("graph_code", StringType())}
            return held.sparkSession.createDataFrame(out, StructType([types[c] for c in out.column_names]))

        with ThreadPoolExecutor(2) as both:
            nodes, edges = both.map(lambda t: side(*t), [("graph_nodes", "node_dict"), ("graph_edges", "edge_dict")])
        return nodes, edges

    def graphs(self, codes: Iterable[str]) -> GraphStore:
        """A store of some graphs, named by a list: their bucket folders, and the folders of the dictionaries that they use."""
        found = self._found(codes)
        ids = [r["graph_id"] for r in found]
        graphs = self.store.graphs.sparkSession.createDataFrame(found, self.files["graphs"].schema).drop("slot", "_n_nodes", "_n_edges")
        graph_nodes, node_dict = self._entries("node_dict", self._members("graph_nodes", ids), sum(r["_n_nodes"] for r in found))
        graph_edges, edge_dict = self._entries("edge_dict", self._members("graph_edges", ids), sum(r["_n_edges"] for r in found))
        return GraphStore(graphs, node_dict, edge_dict, graph_nodes, graph_edges, self.store.meta)
