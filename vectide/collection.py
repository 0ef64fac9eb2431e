"""A collection: records as an immutable table, with its configuration.

Every mutation checks its input with an action first and only then moves the handle to a new table, so a failed call
changes nothing. Long chains of mutations are cut by writing the table to the shared scratch folder.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from vectide.functions.vecmath import rank_key
from vectide.functions.validate import check_dimension, check_query
from vectide.operators import graph as nsw
from vectide.operators import mutate
from vectide.operators.search import batch_knn, exact_topk, metadata_equals, resolve
from vectide.plans.scratch import Scratch
from vectide.schema import EXACT, FLOAT32, RECORD, SCALAR8, GraphParams, IndexKind, encoding_label
from vectide.sources import store

#: Mutations between two cuts of the lineage.
CUT_EVERY = 8


class Collection:
    def __init__(self, spark: SparkSession, records: DataFrame, dimension: int | None, index: IndexKind, encoding: str = FLOAT32, graph: DataFrame | None = None):
        self.spark, self.records, self.dimension, self.index, self.encoding = spark, records, dimension, index, encoding
        self._dead: DataFrame | None = None
        self._n_dead = 0
        self._steps = 0
        self._scratch = Scratch(spark, "collection")
        self._graph = nsw.GraphState(spark, index.params, self._scratch, graph)

    # ------------------------------------------------------------------------------------------------ construction
    @classmethod
    def create(cls, spark: SparkSession, dimension: int | None = None, index: IndexKind = EXACT, encoding: str = FLOAT32) -> "Collection":
        check_dimension(dimension)
        c = cls(spark, spark.createDataFrame([], RECORD), dimension, index)
        c.set_encoding(encoding)
        return c

    def clone(self) -> "Collection":
        """An independent handle without tombstones; its graph is built anew."""
        return Collection(self.spark, self.records, self.dimension, self.index, self.encoding)

    # --------------------------------------------------------------------------------------------------- properties
    def count(self) -> int:
        return self.records.count()

    def is_empty(self) -> bool:
        return self.records.isEmpty()

    def stats(self) -> dict:
        """Records, dimension, index and encoding."""
        return {"records": self.count(), "dimension": self.dimension, "index": self.index.label(), "encoding": encoding_label(self.encoding)}

    @property
    def tombstones(self) -> int:
        return self._n_dead

    def set_encoding(self, encoding: str) -> None:
        """Only affects the next save."""
        if encoding not in (FLOAT32, SCALAR8):
            raise ValueError(f"unknown encoding {encoding}")
        self.encoding = encoding

    # ---------------------------------------------------------------------------------------------------- mutations
    def _rows(self, rows: DataFrame | Iterable) -> DataFrame:
        if isinstance(rows, DataFrame):
            return rows
        full = [(r["id"], [float(x) for x in r["vector"]], r.get("text") or "", dict(r.get("metadata") or {})) for r in rows]
        return self.spark.createDataFrame(full, RECORD)

    def _ids(self, ids: DataFrame | Iterable[int] | int) -> DataFrame:
        if isinstance(ids, DataFrame):
            return ids.select(F.col("id").cast("long").alias("id"))
        ids = [ids] if isinstance(ids, int) else list(ids)
        return self.spark.createDataFrame([(int(i),) for i in ids], "id long")

    def _move(self, records: DataFrame) -> None:
        self._steps += 1
        self.records = self._scratch.table(records, "records") if self._steps % CUT_EVERY == 0 else records

    def _forget_graph(self) -> None:
        self._graph.forget()
        self._dead, self._n_dead = None, 0

    def _added(self, rows: DataFrame, replaced: bool) -> None:
        """New records are inserted into the graph. It is given up, and tombstones with it, only if a record was replaced or a
        deleted id is in use again."""
        self._graph.add(rows)
        if replaced or (self._n_dead and not self._dead.join(rows.select("id"), "id", "left_semi").isEmpty()):
            self._forget_graph()

    def insert(self, rows: DataFrame | Iterable) -> None:
        """Adds records with new ids: all of them or none. A vector's length fixes an unset dimension."""
        rows = self._rows(rows)
        new, dim = mutate.insert(self.records, rows, self.dimension)
        self._move(new)
        self.dimension = dim
        self._added(rows, False)

    def upsert(self, rows: DataFrame | Iterable) -> None:
        """Adds records or replaces those of the same id whole."""
        rows = self._rows(rows)
        new, dim, replaced = mutate.upsert(self.records, rows, self.dimension)
        self._move(new)
        self.dimension = dim
        self._added(rows, replaced)

    def delete(self, ids: DataFrame | Iterable[int] | int) -> DataFrame:
        """Removes records and returns them. The graph keeps their nodes as tombstones until ``compact``."""
        ids = self._ids(ids)
        kept, removed = mutate.delete(self.records, ids)
        dead = ids.select("id").distinct()
        self._dead = dead if self._dead is None else self._dead.unionByName(dead).distinct()
        self._dead = self._scratch.table(self._dead, "dead")
        self._n_dead = self._dead.count()
        self._move(kept)
        return removed

    def compact(self) -> int:
        """Number of tombstones removed; 0 right after."""
        n = self._n_dead
        if n:
            self._move(self._scratch.table(self.records, "records"))
            self._forget_graph()
        return n

    # ------------------------------------------------------------------------------------------------------ queries
    def get(self, id: int) -> Row | None:
        """The record of this id; an equality that Parquet row groups are pruned by."""
        return self.records.where(F.col("id") == id).first()

    def search(self, query: Sequence[float], k: int, where: Mapping[str, str] | None = None, ef: int | None = None) -> DataFrame:
        """``score, id, vector, text, metadata, rank``. Without a filter the configured index answers, with one an exact
        scan of the matching records. A bad query fails even for ``k`` = 0."""
        query = check_query(query, self.dimension)
        if self.index.params is None or where or k < 1:
            hits = exact_topk(self.records, query, k, where, dimension=self.dimension)
            return _ranked(hits)
        hits = self._walk(query, k, ef)
        return resolve(hits, self.records).select("score", *RECORD.names, "rank").orderBy("rank")

    def _walk(self, query: list[float], k: int, ef: int | None) -> DataFrame:
        if self.records.isEmpty():
            return self.spark.createDataFrame([], "query_id long, id long, score float, rank int")
        graph = self._built()
        hits = nsw.walk(graph, [(0, query)], k + self._n_dead, self.index.params, ef)
        hits = nsw.live_hits(hits, self._dead, k) if self._n_dead else hits
        return hits.drop("query_id")

    def search_batch(self, queries: DataFrame, k: int, where: Mapping[str, str] | None = None) -> DataFrame:
        """``query_id, id, score, rank`` for every row (query_id, query_vector) of ``queries``, exact."""
        return batch_knn(self.records, queries, k, where)

    def build_ann_index(self, params: GraphParams | None = None, shards: int | None = None) -> DataFrame:
        """A separate graph over the records."""
        n = self.records.count()
        g = nsw.build(self.records, params or GraphParams(), shards=shards or nsw.shards_for(n))
        return self._scratch.table(g, "graph")

    def _built(self) -> DataFrame:
        return self._graph.get(self.records)

    # ------------------------------------------------------------------------------------------------------ storage
    def save(self, path: str) -> None:
        """The graph goes with the records unless tombstones are pending. Afterwards this handle reads what was saved, or,
        with lossy encoding, a scratch table, so later saves may remove what it was loaded from."""
        graph = None
        if self.index.params is not None and not self._n_dead and not self.is_empty():
            graph = self._built()
        if self.encoding != FLOAT32:
            self.records = self._scratch.table(self.records, "records")
        store.save(self.spark, path, self.records, dimension=self.dimension, index=self.index, encoding=self.encoding, graph=graph)
        if self.encoding == FLOAT32:
            self.records = store.scan(self.spark, path, store.read_manifest(self.spark, path))
            if self._graph.given:
                self._graph.forget()

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Collection":
        s = store.load(spark, path)
        return cls(spark, s.records, s.dimension, s.index, s.encoding, s.graph)

    def export_json(self, path: str) -> None:
        store.export_json(self.spark, path, self.records, self.dimension, self.index)

    def export_json_lines(self, path: str) -> None:
        """A folder of JSON lines, written in parallel."""
        store.export_json_lines(self.records, path)

    @classmethod
    def import_json_lines(cls, spark: SparkSession, path: str, index: IndexKind = EXACT) -> "Collection":
        """A new collection with the records of JSON lines; ids must not repeat."""
        c = cls.create(spark, index=index)
        c.insert(store.import_json_lines(spark, path))
        return c

    @classmethod
    def import_json(cls, spark: SparkSession, path: str) -> "Collection":
        rows, dim, index = store.import_json(spark, path)
        return cls(spark, rows, dim, index)


class LazyCollection:
    """Read-only view of a saved collection: the manifest is checked, rows are read by each query, only the columns it
    needs. Searches are always exact; records are not validated."""

    def __init__(self, spark: SparkSession, path: str):
        self.about = store.read_manifest(spark, path)
        self.dimension: int | None = self.about["dimension"]
        self.records = store.scan(spark, path, self.about)

    def count(self) -> int:
        return int(self.about["rows"])

    def is_empty(self) -> bool:
        return self.count() == 0

    def search(self, query: Sequence[float], k: int, where: Mapping[str, str] | None = None) -> DataFrame:
        """Scores ids first; payloads are fetched for the ``k`` survivors only, by ids that Parquet pages are pruned by."""
        query = check_query(query, self.dimension)
        cond = metadata_equals(where)
        slim = self.records if cond is None else self.records.where(cond)
        top = exact_topk(slim.select("id", "vector"), query, k, dimension=self.dimension).select("id", "score")
        return _ranked(resolve(top, self.records))


def _ranked(hits: DataFrame) -> DataFrame:
    w = Window.orderBy(rank_key(F.col("score")).desc(), "id")  # at most k rows
    return hits.withColumn("rank", F.row_number().over(w)).select("score", *RECORD.names, "rank").orderBy("rank")


__all__ = ["Collection", "LazyCollection"]
