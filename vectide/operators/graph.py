"""Approximate search on navigable small-world graphs, one a shard.

Building a graph is sequential by nature, so ids are dealt over shards of bounded size, each shard's graph is built in one
task in ascending id order, and a search walks every shard in parallel; the best hits of all shards are merged. Shards
are sized by ``shard_rows``, so a task's memory doesn't grow with the collection. A shard is one row of a packed table (ids,
links and vectors as bytes), so a search is a scan without a shuffle, and new records are inserted into the shards that
they belong to.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectide.errors import Corrupt
from vectide.functions import vecmath as vm
from vectide.functions.validate import check_dimension, check_query, check_rows
from vectide.plans.scratch import Scratch
from vectide.schema import GraphParams

#: Rows of one shard's graph.
SHARD_ROWS = 20_000
#: A shard as one row: ``ids`` (64 bits), ``degrees`` and ``links`` (32 bits), ``vectors`` (floats), all in node order.
PACKED = "shard int, shards int, nodes int, ids binary, degrees binary, links binary, vectors binary"
_PACKED = pa.schema([("shard", pa.int32()), ("shards", pa.int32()), ("nodes", pa.int32()), *((n, pa.binary()) for n in ("ids", "degrees", "links", "vectors"))])


class _Links:
    """Links of all nodes in one array; a node's list is made when it is asked for."""

    def __init__(self, degrees: np.ndarray, links: np.ndarray):
        self.ends, self.links = np.concatenate([[0], np.cumsum(degrees)]), links

    def __len__(self) -> int:
        return len(self.ends) - 1

    def __getitem__(self, node: int) -> list[int]:
        return self.links[self.ends[node] : self.ends[node + 1]].tolist()


class ShardGraph:
    """Vectors of a shard with directed links. Nodes are numbered in insertion order; searches start at node 0."""

    def __init__(self, params: GraphParams, dim: int, room: int = 16):
        self.params = params
        self.ids: list[int] = []
        self.x = np.zeros((room, dim), np.float32)
        self.u = np.zeros((room, dim), np.float32)
        self.links: list[list[int]] | _Links = []

    def search(self, q: np.ndarray, ef: int) -> list[tuple[float, int]]:
        """Best-first walk: (similarity, node) of at most ``ef`` nodes, best first, later nodes first on ties."""
        if not len(self.links):
            return []
        u, links, q = self.u, self.links, _units(q[None, :])[0]
        first = float(u[0] @ q)
        seen = bytearray(len(links))
        seen[0] = 1
        frontier = [(-first, 0)]  # on ties later nodes are expanded first
        best = [(first, 0)]
        while frontier:
            s, node = heapq.heappop(frontier)
            if len(best) >= ef and -s < best[0][0]:
                break
            new = [x for x in links[-node] if not seen[x]]
            if not new:
                continue
            for v, x in zip((u[new] @ q).tolist(), new):
                seen[x] = 1
                if len(best) < ef:
                    heapq.heappush(best, (v, x))
                elif v > best[0][0]:
                    heapq.heapreplace(best, (v, x))
                else:
                    continue
                heapq.heappush(frontier, (-v, -x))
        return sorted(best, reverse=True)

    def insert(self, vector: np.ndarray) -> None:
        p, me = self.params, len(self.links)
        near = self.search(vector, max(p.ef_construction, p.max_neighbors))[: p.max_neighbors]
        if me == len(self.x):
            more = max(16, me)
            self.x, self.u = (np.concatenate([a, np.zeros((more, a.shape[1]), np.float32)]) for a in (self.x, self.u))
        self.x[me] = vector
        self.u[me] = _units(vector[None, :])[0]
        self.links.append([])
        for _, other in near:
            self._link(me, other)
            self._link(other, me)

    def _link(self, a: int, b: int) -> None:
        """Adds a link one way; a node over its bound keeps its most similar ones (a dropped link stays in reverse)."""
        links = self.links[a]
        if b not in links:
            links.append(b)
        if len(links) > self.params.max_neighbors:
            s = self.u[links] @ self.u[a]
            links[:] = [links[i] for i in np.lexsort((links, -s))[: self.params.max_neighbors]]

    def pack(self, shard: int, shards: int) -> pa.Table:
        n = len(self.links)
        flat = np.array([x for links in self.links for x in links], np.int32)
        bytes_ = (np.array(self.ids, np.int64), np.array([len(x) for x in self.links], np.int32), flat, np.ascontiguousarray(self.x[:n]))
        return pa.table([[shard], [shards], [n], *([b.tobytes()] for b in bytes_)], schema=_PACKED)

    @classmethod
    def unpack(cls, row: dict, params: GraphParams, mutable: bool = False) -> "ShardGraph":
        g = cls(params, 1, 0)
        ids, degrees, links = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["degrees"], np.int32), np.frombuffer(row["links"], np.int32)
        g.x = np.frombuffer(row["vectors"], np.float32).reshape(len(ids), -1)
        g.u, g.ids, g.links = _units(g.x), ids, _Links(degrees, links)
        if mutable:
            g.ids, g.links = ids.tolist(), [g.links[i] for i in range(len(ids))]
        return g

    def reachable(self) -> int:
        seen, todo = ({0}, [0]) if len(self.links) else (set(), [])
        while todo:
            for x in self.links[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return len(seen)


def _units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows whose norm is 0 or overflows are similar to nothing."""
    n = vm.norms(x)
    fine = (n > 0) & np.isfinite(n)
    return np.where(fine[:, None], x, 0) / np.where(fine, n, 1)[:, None]


def shards_for(rows: int, shard_rows: int = SHARD_ROWS) -> int:
    return max(1, -(-rows // shard_rows))


def _dealt(records: DataFrame, shards, id: str, vector: str) -> DataFrame:
    shard = F.pmod(F.xxhash64(F.col(id).cast("long")), F.lit(shards)).cast("int")
    return records.select(shard.alias("shard"), F.col(id).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("vector"))


def _inserted(g: ShardGraph | None, table: pa.Table, params: GraphParams) -> ShardGraph:
    """The rows of ``table`` inserted in ascending id order."""
    table = table.sort_by("id")
    x = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)
    g = g or ShardGraph(params, x.shape[1], len(table))
    for i, v in zip(table.column("id").to_pylist(), x):
        g.insert(v)
        g.ids.append(i)
    return g


def build(records: DataFrame, params: GraphParams, *, shards: int = 1, id: str = "id", vector: str = "vector") -> DataFrame:
    """The packed graph of every shard, built in ascending id order."""

    def run(table: pa.Table) -> pa.Table:
        return _inserted(None, table, params).pack(table.column("shard")[0].as_py(), shards)

    return _dealt(records, shards, id, vector).groupBy("shard").applyInArrow(run, PACKED)


def extend(graph: DataFrame, records: DataFrame, params: GraphParams, shards: int, *, id: str = "id", vector: str = "vector") -> DataFrame:
    """``graph`` (of ``shards`` shards) with new records inserted into the shards they belong to; other shards stay."""

    def run(old: pa.Table, new: pa.Table) -> pa.Table:
        if not len(new):
            return old.cast(_PACKED)
        shard = new.column("shard")[0].as_py()
        g = ShardGraph.unpack(old.to_pylist()[0], params, mutable=True) if len(old) else None
        return _inserted(g, new, params).pack(shard, shards)

    rows = _dealt(records, shards, id, vector)
    return graph.groupBy("shard").cogroup(rows.groupBy("shard")).applyInArrow(run, PACKED)


def structure(graph: DataFrame) -> DataFrame:
    """``shard, node, id, neighbors`` of a packed graph, a row a node."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                g = ShardGraph.unpack(row, GraphParams())
                n = len(g.links)
                links = pa.ListArray.from_arrays(pa.array(g.links.ends, pa.int32()), pa.array(g.links.links, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row["shard"]), pa.int32()), pa.array(np.arange(n), pa.int32()), pa.array(g.ids), links], names=["shard", "node", "id", "neighbors"])

    return graph.mapInArrow(run, "shard int, node int, id long, neighbors array<int>")


def assemble(links: DataFrame, records: DataFrame) -> DataFrame:
    """The packed graph of a structure and the records that it names."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        g = ShardGraph(GraphParams(), 1, 0)
        g.ids, g.links = table.column("id").to_numpy(), table.column("neighbors").to_pylist()
        g.x = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1).astype(np.float32)
        return g.pack(table.column("shard")[0].as_py(), table.column("shards")[0].as_py())

    rows = links.join(records.select("id", F.col("vector").cast("array<float>").alias("vector")), "id")
    top = links.agg((F.max("shard") + 1).cast("int").alias("shards"))  # one row
    return rows.crossJoin(F.broadcast(top)).groupBy("shard").applyInArrow(run, PACKED)


def walk(graph: DataFrame, queries: list[tuple[int, list[float]]], k: int, params: GraphParams, ef: int | None = None, tie_break: str = "id") -> DataFrame:
    """``query_id, id, score, rank``: the ``k`` best of all shards for each of a few queries, which travel with the plan.

    The walk keeps max(ef, k) candidates a shard. Final scores are recomputed in component order, so they equal exact
    ones. Ties rank by id; with one shard, ``tie_break="node"`` ranks later-inserted nodes first.
    """
    width = max(ef or params.ef_search, k)

    def run(batches):
        kinds = (pa.int64(), pa.int64(), pa.float32(), pa.int32())
        for b in batches:
            for row in b.to_pylist():
                g = ShardGraph.unpack(row, params)
                rows = []
                for qid, q in queries:
                    if len(q) != g.x.shape[1]:
                        continue
                    nodes = [n for _, n in g.search(np.asarray(q, np.float32), width)]
                    score = vm.cosines(g.x[nodes], q)
                    order = np.lexsort((-np.array(nodes) if tie_break == "node" else g.ids[nodes], -score))[:k]
                    rows += [(qid, int(g.ids[nodes[i]]), float(score[i]), int(nodes[i])) for i in order]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["query_id", "id", "score", "node"])

    hits = graph.mapInArrow(run, "query_id long, id long, score float, node int")
    tie = F.desc("node") if tie_break == "node" else F.asc("id")
    w = Window.partitionBy("query_id").orderBy(vm.rank_key(F.col("score")).desc(), tie)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")


class GraphState:
    """A packed graph that is built, or written to scratch if it was given, when it is first asked for; records added later
    are inserted into it, unless it would outgrow its shards twofold: then it is built anew."""

    def __init__(self, spark: SparkSession, params: GraphParams, scratch: Scratch, graph: DataFrame | None = None):
        self.spark, self.params, self.scratch, self.graph = spark, params, scratch, graph
        self.given = graph is not None
        self.new: DataFrame | None = None

    def add(self, rows: DataFrame) -> None:
        if self.graph is not None:
            rows = rows.select("id", "vector")
            self.new = rows if self.new is None else self.new.unionByName(rows)

    def forget(self) -> None:
        self.graph, self.new, self.given = None, None, False

    def get(self, records: DataFrame) -> DataFrame:
        if self.given:
            self.graph, self.given = self.scratch.table(self.graph, "graph"), False
        if self.graph is None:
            self.graph = self.scratch.table(build(records, self.params, shards=shards_for(records.count())), "graph")
        elif self.new is not None:
            held = self.graph.agg(F.max("shards").alias("shards"), F.sum("nodes").alias("nodes")).first()
            if held["nodes"] + self.new.count() > 2 * SHARD_ROWS * held["shards"]:
                self.forget()
                return self.get(records)
            self.graph = self.scratch.table(extend(self.graph, self.new, self.params, held["shards"]), "graph")
        self.new = None
        return self.graph


class AnnIndex:
    """A graph index of its own, apart from any collection. Ids are not checked for repeats; vectors are."""

    def __init__(self, spark: SparkSession, params: GraphParams | None = None, dimension: int | None = None):
        check_dimension(dimension)
        self.spark, self.params, self.dimension = spark, params or GraphParams(), dimension
        self.rows = spark.createDataFrame([], "id long, vector array<float>")
        self._state = GraphState(spark, self.params, Scratch(spark, "index"))

    def insert(self, rows: DataFrame | list[tuple[int, Sequence[float]]]) -> None:
        """Adds vectors; an unset dimension is fixed by the first. They are inserted into the graph at the next search."""
        if not isinstance(rows, DataFrame):
            rows = self.spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in rows], "id long, vector array<float>")
        rows = rows.select("id", F.col("vector").cast("array<float>").alias("vector"))
        self.dimension = check_rows(rows, self.dimension)
        self.rows = self.rows.unionByName(rows)
        self._state.add(rows)

    def count(self) -> int:
        return self.rows.count()

    def is_empty(self) -> bool:
        return self.rows.isEmpty()

    @property
    def graph(self) -> DataFrame:
        return self._state.get(self.rows)

    def search(self, query: Sequence[float], k: int) -> DataFrame:
        return self.search_with_ef(query, k, self.params.ef_search)

    def search_with_ef(self, query: Sequence[float], k: int, ef: int) -> DataFrame:
        """``id, score, rank`` of the ``k`` best of max(ef, k) candidates a shard."""
        query = check_query(query, self.dimension)
        if k < 1 or self.is_empty():
            return self.spark.createDataFrame([], "id long, score float, rank int")
        return walk(self.graph, [(0, query)], k, self.params, ef).drop("query_id")

    def persisted(self) -> DataFrame:
        """The graph's structure, without vectors."""
        return structure(self.graph)

    @classmethod
    def restore(cls, records: DataFrame, links: DataFrame, params: GraphParams | None = None) -> "AnnIndex":
        """From a structure and the records that it names; a structure that does not fit raises ``Corrupt``."""
        index = cls(records.sparkSession, params)
        check_graph(links, records)
        index.rows = records.select("id", "vector")
        index.dimension = check_rows(index.rows, None)
        index._state = GraphState(index.spark, index.params, index._state.scratch, assemble(links, index.rows))
        return index


def live_hits(hits: DataFrame, tombstones: DataFrame, k: int) -> DataFrame:
    """Hits fetched in excess, without deleted ids, cut to ``k`` a query again."""
    alive = hits.join(tombstones.select("id"), "id", "left_anti")
    w = Window.partitionBy("query_id").orderBy("rank")
    return alive.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def reachable(graph: DataFrame) -> DataFrame:
    """``shard, nodes, reachable``: pruning may cut nodes off from their shard's entry."""

    def run(batches):
        for b in batches:
            for row in b.select(["shard", "ids", "degrees", "links", "vectors"]).to_pylist():
                g = ShardGraph.unpack(row, GraphParams())
                yield pa.RecordBatch.from_arrays([pa.array([row["shard"]], pa.int32()), pa.array([len(g.links)], pa.int64()), pa.array([g.reachable()], pa.int64())], names=["shard", "nodes", "reachable"])

    return graph.mapInArrow(run, "shard int, nodes long, reachable long")


def check_graph(graph: DataFrame, records: DataFrame) -> None:
    """A stored graph must name known ids, and links must stay in their shard."""
    unknown = graph.join(records.select("id"), "id", "left_anti").agg(F.min("id")).first()[0]
    if unknown is not None:
        raise Corrupt(f"the graph names id {unknown}, which has no record")
    size = graph.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max("neighbors")).alias("top"), F.min(F.array_min("neighbors")).alias("low"), F.min("node").alias("first"), F.max("node").alias("last"))
    bad = size.where("top >= n OR low < 0 OR first != 0 OR last != n - 1").limit(1).collect()
    if bad:
        raise Corrupt(f"a link of shard {bad[0]['shard']} leaves the graph")
