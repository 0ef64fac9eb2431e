"""A varied subset by distributed farthest-first selection.

A point is a unit vector extended by weighted indicators of its metadata values, so that distance grows with both. Each
partition selects greedily, always the point farthest from those selected (k-center); the partitions' choices are pooled and
ordered by the distance that each had from those selected before it; the subset is what this order has first. Passes over the
whole pool follow: every point gets its distance from the nearest point before it (first of all points, then of the subset so far),
in whatever partition, and these distances give the next order. When the subset stays the same, its points are at least one
shared radius apart, and every other point of the pool is nearer than that to one of them. The same definition holds at every
size: blocks of the pool meet in pairs, so their size decides about work and not about results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectide.llm import forest as rp
from vectide.plans.scratch import Scratch

DIM = 96
#: Rows of one partition of the first round.
PART_ROWS = 4096
#: Points of one block of the pool; any two blocks meet in one task.
POOL_MOST = 65_536
#: Passes over the pool, if the subset doesn't stay the same before.
PASSES = 20
#: Distances that a task holds at once.
AT_ONCE = 1 << 21
#: Points that partitions select for each one that is wanted.
OVER = 3
#: Weights of the metadata indicators in squared distance (two unit vectors are at most 4 apart, unrelated ones 2).
WEIGHTS = {"topic": 0.6, "source": 0.3, "lang": 0.1}
#: Squared distance of a point that is the first one.
FAR = 64.0
#: Steps of squared distance by which the pool is counted; there are at most FAR * STEPS of them.
STEPS = 1000


def farthest_first(x: np.ndarray, labels: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """Row numbers in the order of selection. ``x``: rows in a fixed order; ``labels``: rows x keys of integer values,
    each differing value adding its weight to the squared distance. Starts at row 0; ties take the earlier row. Rows at
    distance 0 of a selected one (copies) are selected only when nothing else is left."""
    return order_of(x, labels, weights, k)[0]


def order_of(x: np.ndarray, labels: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``farthest_first`` with the squared distance of each selected row from those before it."""
    n = len(x)
    k = min(k, n)
    if k == 0:
        return np.zeros(0, int), np.zeros(0, np.float32)
    sq = (x * x).sum(1)
    picked, apart = np.empty(k, int), np.full(k, FAR, np.float32)
    near = np.full(n, np.inf, np.float32)
    free = np.ones(n, bool)
    at = 0
    for i in range(k):
        picked[i] = at
        apart[i] = min(near[at], FAR)
        free[at] = False
        np.minimum(near, _squares(x, sq, labels, weights, at), out=near)
        at = int(np.argmax(np.where(free, near, -1)))
    return picked, apart


def _squares(x: np.ndarray, sq: np.ndarray, labels: np.ndarray, weights: np.ndarray, at: int) -> np.ndarray:
    d = sq + sq[at] - 2 * (x @ x[at])
    np.maximum(d, 0, out=d)
    d[d < 1e-6] = 0
    for j in range(labels.shape[1]):
        d += weights[j] * (labels[:, j] != labels[at, j])
    return d


def from_earlier(
    x: np.ndarray, labels: np.ndarray, weights: np.ndarray, side: np.ndarray | None = None, among: np.ndarray | None = None,
) -> np.ndarray:
    """Each row's squared distance from the nearest row before it; with ``side`` (booleans) from rows of the other side only, with
    ``among`` from those it marks. Candidates in single precision, the distance in double precision, rounded to millionths."""
    rows = np.arange(len(x))
    sq, to = (x * x).sum(1), np.full(len(x), -1)
    codes = np.stack([np.unique(c, return_inverse=True)[1] for c in labels.T], 1).astype(np.int32) if labels.size else labels
    for a, b in ((rows, rows),) if side is None else ((rows[~side], rows[side]), (rows[side], rows[~side])):
        b = b if among is None else b[among[b]]
        if not len(b):
            continue
        xb, sb, cb = x[b], sq[b], np.ascontiguousarray(codes[b].T)
        step = max(1, AT_ONCE // len(b))
        for s in range(0, len(a), step):
            at = a[s : s + step]
            d = x[at] @ xb.T
            d *= -2
            d += sq[at][:, None]
            d += sb
            for j in range(codes.shape[1]):
                d += np.float32(weights[j]) * (codes[at, j][:, None] != cb[j])
            d[at[:, None] <= b] = np.inf
            best = d.argmin(1)
            to[at] = np.where(np.isfinite(d[np.arange(len(at)), best]), b[best], -1)
    out, found = np.full(len(x), FAR), np.flatnonzero(to >= 0)
    for s in range(0, len(found), 8192):
        i = found[s : s + 8192]
        d = ((x[i].astype(np.float64) - x[to[i]].astype(np.float64)) ** 2).sum(1)
        d[d < 1e-6] = 0
        out[i] = np.minimum(d + (labels[i] != labels[to[i]]) @ weights.astype(np.float64), FAR)
    return np.round(out, 6).astype(np.float32)


def varied_subset(
    records: DataFrame, size: int, *, id: str = "id", vector: str = "vector", metadata: str = "metadata", dim: int = DIM,
    weights: dict[str, float] | None = None, part_rows: int = PART_ROWS, pool_most: int = POOL_MOST,
) -> DataFrame:
    """``id, place``: ``size`` ids (all, if there are fewer) in the order of selection.

    Metadata values are compared without white space at both ends and in lower case; a missing key or null map is a value
    of its own. Rows whose vector is null, zero, not finite or of another length take part with a zero vector. Null ids
    are left out; of rows that repeat an id one counts. Ties go to the smaller hash of the id, so runs agree. ``size``
    < 1 and empty tables give no rows.
    """
    weights = WEIGHTS if weights is None else weights
    spark = records.sparkSession
    scratch = Scratch(spark, "diverse")
    v = records[vector].cast("array<float>")
    fine = v.isNotNull() & (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    cell = [F.xxhash64(F.lower(F.trim(F.regexp_replace(records[metadata][k], r"[\s\p{Z}]+", " ")))) for k in weights]
    rows = records.select(
        records[id].cast("long").alias("id"), F.when(fine, v).otherwise(F.array_repeat(F.lit(0.0).cast("float"), dim)).alias("v"), F.array(*cell).alias("m"),
    ).where("id IS NOT NULL")
    count = rows.count()
    size = min(size, count)
    if size < 1:
        return spark.createDataFrame([], "id long, place int")
    w = np.array(list(weights.values()), np.float32)
    share = min(1.0, OVER * size / count)
    parts = -(-count // part_rows)
    spread = F.pmod(F.xxhash64("id", F.lit(parts)), F.lit(parts)).cast("int")
    pool = scratch.table(_select(rows, spread, lambda n: max(8, int(np.ceil(n * share))), w, dim), "pool")
    left = pool.count()
    size = min(size, left)
    order, taken = pool.select("id", "apart", F.lit(True).alias("among")), None
    for _ in range(PASSES):
        apart = scratch.table(_ordered(pool.drop("apart").join(order, "id"), -(-left // pool_most), w, dim), "order")
        before, taken = taken, scratch.table(_first(apart, size), "taken")
        if before is not None and before.join(taken, "id", "left_semi").count() == size:
            break
        order = apart.join(taken.select("id", F.lit(True).alias("among")), "id", "left").fillna(False, ["among"])
    return taken


def _first(order: DataFrame, size: int) -> DataFrame:
    """``id, place`` of the ``size`` rows that are farthest apart, of equal ones the smaller hash of the id. Rows are counted
    by steps of distance, and in the last step that is needed by hash; only these counts reach the driver."""
    h = F.xxhash64("id")
    rows = order.select("id", "apart", h.alias("h"), F.floor((F.lit(FAR) - F.col("apart")) * STEPS).cast("int").alias("step"))
    steps = sorted((r["step"], r["n"]) for r in rows.groupBy("step").agg(F.count(F.lit(1)).alias("n")).collect())
    before, taken = [], 0
    for step, n in steps:
        before.append((step, taken))
        if taken + n >= size:
            break
        taken += n
    last, want = before[-1][0], size - taken
    part = F.shiftrightunsigned("h", 52)
    at_last = rows.where(F.col("step") == last)
    if n > want:
        parts = sorted((r["p"], r["n"]) for r in at_last.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
        cut = 0
        while want >= parts[cut][1]:
            want -= parts[cut][1]
            cut += 1
            if cut == len(parts):
                break
        whole = at_last.where(part < (parts[cut][0] if cut < len(parts) else 4096))
        rest = at_last.where(part == parts[cut][0]).orderBy(part, "h", "id").limit(want) if cut < len(parts) and want else at_last.limit(0)
        at_last = whole.unionByName(rest)
    rows = rows.where(F.col("step") < last).unionByName(at_last)
    rows = rows.join(F.broadcast(order.sparkSession.createDataFrame(before, "step int, before long")), "step")
    within = F.row_number().over(Window.partitionBy("step").orderBy(F.desc("apart"), "h", "id"))
    return rows.select("id", (F.col("before") + within).cast("int").alias("place"))


_POINTS = pa.schema([("id", pa.int64()), ("v", pa.list_(pa.float32())), ("m", pa.list_(pa.int64())), ("apart", pa.float32())])
_KIND = "id long, v array<float>, m array<long>, apart float"


def _points(table: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return rp.unit(rp.matrix(table.column("v"), dim)), table.column("m").combine_chunks().flatten().to_numpy().reshape(len(table), -1)


def _select(rows: DataFrame, part, quota, w: np.ndarray, dim: int) -> DataFrame:
    """Farthest-first in each part: the rows selected and how far each was from those before it."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        h = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)
        order = np.lexsort((ids, h))
        order = order[np.r_[True, ids[order][1:] != ids[order][:-1]]] if len(order) else order
        table = table.take(pa.array(order))
        got, apart = order_of(*_points(table, dim), w, quota(len(table)))
        return table.take(pa.array(got)).select(["id", "v", "m"]).append_column("apart", pa.array(apart)).cast(_POINTS)

    return rows.select("id", "v", "m", part.alias("part")).groupBy("part").applyInArrow(run, _KIND)


def _ordered(rows: DataFrame, blocks: int, w: np.ndarray, dim: int) -> DataFrame:
    """``id, apart``: each row's distance from the nearest of all rows before it that ``among`` marks; before is what was farther
    apart, of equal rows the smaller hash. Every row is sent once to each block."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        h = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)
        table = table.take(pa.array(np.lexsort((ids, h, -table.column("apart").to_numpy()))))
        side = table.column("block").to_numpy() > table.column("low").to_numpy()
        one = table.column("high")[0].as_py() == table.column("low")[0].as_py()
        apart = from_earlier(*_points(table, dim), w, None if one else side, table.column("among").to_numpy())
        return pa.table({"id": table.column("id"), "apart": pa.array(apart)})

    block = F.pmod(F.xxhash64("id", F.lit(blocks)), F.lit(blocks)).cast("int")
    sent = rows.select("*", block.alias("block")).select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    sent = sent.select("id", "v", "m", "apart", "among", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    return sent.groupBy("low", "high").applyInArrow(run, "id long, apart float").groupBy("id").agg(F.min("apart").alias("apart"))


def p6_subset(spark, sf_dir: str) -> DataFrame:
    """A hundredth of the records, at least 20, by vector and metadata."""
    records = spark.read.parquet(f"{sf_dir}/records.parquet").select("id", "vector", "metadata")
    return varied_subset(records, max(20, -(-records.count() // 100))).select("id", "place")


QUERIES = {"p6_subset": p6_subset}
SQL: dict[str, str] = {}
