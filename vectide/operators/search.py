"""Nearest-neighbour search by cosine: single queries as pure expressions, batches as Arrow blocks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectide.functions import vecmath as vm
from vectide.functions.validate import check_query


def metadata_equals(wanted: Mapping[str, str] | None, metadata: str = "metadata") -> Column | None:
    """Every key must have exactly this value; a missing key does not match; nothing wanted matches all."""
    cond = None
    for key, value in (wanted or {}).items():
        one = F.col(metadata)[key] == F.lit(value)
        cond = one if cond is None else cond & one
    return cond


def scored(df: DataFrame, query: Sequence[float], vector: str = "vector") -> DataFrame:
    """``df`` with ``score``; the query's norm is a constant of the plan."""
    q = vm.vector_literal(query)
    return df.withColumn("score", vm.cosine(F.col(vector), q, F.lit(float(vm.norm_of(query))).cast("float")))


def exact_topk(df: DataFrame, query: Sequence[float], k: int, where: Mapping[str, str] | None = None, *, dimension: int | None = None, id: str = "id", vector: str = "vector") -> DataFrame:
    """The ``k`` best rows by score descending, then id: a bounded heap a partition, then one merge.

    The filter comes before the scores. ``k`` of 0 gives no rows, after the query has been checked; fewer rows than
    ``k`` give all. NaN scores (overflowing components) rank last.
    """
    query = check_query(query, dimension)
    cond = metadata_equals(where)
    rows = df if cond is None else df.where(cond)
    out = scored(rows, query, vector)
    return out.orderBy(vm.rank_key(F.col("score")).desc(), F.col(id)).limit(max(0, int(k)))


def batch_knn(df: DataFrame, queries: DataFrame, k: int, where: Mapping[str, str] | None = None, *, id: str = "id", vector: str = "vector", query_id: str = "query_id", query_vector: str = "query_vector", block: int = 256, most_bytes: int = 32 << 20) -> DataFrame:
    """``query_id, id, score, rank``: the ``k`` best rows for each query.

    Queries are split into groups of ``most_bytes``; each group is a broadcast of that bounded size, every scan task
    keeps its own best ``k`` of each query, and only these are shuffled, by query. Queries that are null, empty or not
    of the rows' length have no result. Scores are the same bits as those of ``exact_topk``.
    """
    spark = df.sparkSession
    cond = metadata_equals(where)
    rows = (df if cond is None else df.where(cond)).select(F.col(id).cast("long").alias("id"), F.col(vector).alias("vector"))
    q = queries.select(F.col(query_id).cast("long").alias("q"), F.col(query_vector).cast("array<float>").alias("v")).where("q IS NOT NULL AND size(v) > 0")
    held = q.agg(F.sum(F.size("v") * 4 + 16)).first()[0] or 0
    groups = max(1, -(-held // most_bytes))
    parts = []
    for g in range(groups):
        part = q if groups == 1 else q.where(F.pmod(F.xxhash64("q"), F.lit(groups)) == g)
        got = part.toArrow()
        lists = got.column("v").combine_chunks()
        shared = spark.sparkContext.broadcast((got.column("q").to_numpy(), np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False).astype(np.float32)))
        parts.append(rows.mapInArrow(_local_best(shared, k, block), "q long, id long, score float"))
    best = parts[0]
    for p in parts[1:]:
        best = best.unionByName(p)
    w = Window.partitionBy("q").orderBy(vm.rank_key(F.col("score")).desc(), "id")
    best = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.select(F.col("q").alias(query_id) if query_id != id else F.col("q").alias("query_id"), F.col("id").alias(id), "score", "rank")


def _local_best(shared, k: int, block: int):
    """Best ``k`` of the rows of one task for each query."""

    def run(batches):
        qid, lengths, values = shared.value
        ends = np.cumsum(lengths)
        by_len = {int(d): np.flatnonzero(lengths == d) for d in np.unique(lengths)}
        keep: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            lists = b.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.values.to_numpy(zero_copy_only=False)
            start = lists.offsets.to_numpy()[:-1]
            for d in np.unique(sizes):
                if d not in by_len or k < 1:
                    continue
                at = np.flatnonzero(sizes == d)
                x = flat[start[at][:, None] + np.arange(d)].astype(np.float32)
                n = vm.norms(x)
                cols = np.ascontiguousarray(x.T)
                chosen = by_len[d]
                for s in range(0, len(chosen), block):
                    qs = chosen[s : s + block]
                    m = values[(ends[qs] - d)[:, None] + np.arange(d)]
                    with np.errstate(all="ignore"):
                        total = np.zeros((len(qs), len(x)), np.float32)
                        for c in range(d):
                            total += m[:, c : c + 1] * cols[c]
                        below = n[None, :] * vm.norms(m)[:, None]
                        score = np.where(below == 0, 0, total.astype(np.float64) / np.where(below == 0, 1, below)).astype(np.float32)
                    for row, i in zip(score, qs):
                        old = keep.get(i)
                        si = (row, ids[at]) if old is None else (np.concatenate([old[0], row]), np.concatenate([old[1], ids[at]]))
                        keep[i] = _cut(*si, k)
        for i in keep:
            s, r = keep[i]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), qid[i])), pa.array(r), pa.array(s)], names=["q", "id", "score"])

    return run


def _cut(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    key = np.where(np.isnan(score), -np.inf, score)
    if len(key) > k:
        bar = np.partition(-key, k - 1)[k - 1]
        at = np.flatnonzero(-key <= bar)
        at = at[np.lexsort((ids[at], -key[at]))][:k]
        return score[at], ids[at]
    return score, ids


#: Hits up to so many are fetched by their ids, which reach the scan as a pushed filter.
FETCHED = 1000


def resolve(hits: DataFrame, records: DataFrame, id: str = "id") -> DataFrame:
    """Payload of hits; hits whose record is gone are dropped. Up to ``FETCHED`` hits are found first and their records read by
    id; more are joined."""
    got = hits.limit(FETCHED + 1).toArrow()
    if len(got) > FETCHED:
        return hits.join(records, id)
    ids = sorted(set(got.column(id).to_pylist()) - {None})
    local = hits.sparkSession.createDataFrame(got.to_pylist(), hits.schema)
    return F.broadcast(local).join(records.where(F.col(id).isin(ids)), id)


def recall_at_k(truth: DataFrame, got: DataFrame, query_id: str = "query_id", id: str = "id") -> DataFrame:
    """``query_id, recall``: the share of each query's true hits that was found."""
    hit = truth.join(got.select(query_id, id).distinct().withColumn("hit", F.lit(1)), [query_id, id], "left")
    return hit.groupBy(query_id).agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1))).alias("recall"))
