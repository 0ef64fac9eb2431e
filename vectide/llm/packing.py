"""Filling containers of fixed capacity by pattern packing.

Only the histogram of item sizes (at most ``capacity`` numbers) reaches the driver. There, patterns of few sizes that
fill a container are enumerated, their repeat counts are fitted to the histogram by non-negative least squares and
rounded down, and what is left of the histogram is packed by best fit, size by size. The resulting plan says, for each
size, which ranks of its items go to which containers; it has a few thousand rows whatever the corpus holds. Items get
their rank within their size in two levels, in as many buckets as the size has items for, so that one size held by a third
of all items is still ranked in parallel.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectide.llm.bpe import count_tokens
from vectide.plans.scratch import Scratch, broadcast_if

CAPACITY = 2048
#: Items of one size that are ranked in one bucket.
BUCKET_ROWS = 100_000
#: Offsets of up to so many buckets are broadcast; more are joined by a shuffle.
SMALL = 100_000
_PLAN = "size int, start long, stop long, base long, per int"


def patterns(sizes: list[int], weight: np.ndarray, capacity: int, most: int = 3000) -> list[dict[int, int]]:
    """Patterns ``{size: times}`` of at most four different sizes: each size repeated or alone, completed by the pair,
    triple or repeat that leaves the least space."""
    have = sorted(sizes)
    common = sorted(have, key=lambda s: (-weight[s], s))[:24]
    found: dict[tuple, dict[int, int]] = {}

    def add(p: dict[int, int]) -> None:
        found.setdefault(tuple(sorted(p.items())), p)

    def fit(room: int) -> int | None:
        i = bisect_right(have, room)
        return have[i - 1] if i else None

    for s in reversed(have):
        for times in dict.fromkeys((1, capacity // s, max(1, capacity // s // 2))):
            p, room = {s: times}, capacity - s * times
            for _ in range(3):
                if (t := fit(room)) is None:
                    break
                p[t] = p.get(t, 0) + room // t
                room -= t * (room // t)
            add(p)
        for c in common:
            room = capacity - s - c
            if room >= 0:
                p = {s: 1}
                p[c] = p.get(c, 0) + 1
                if (t := fit(room)) is not None:
                    p[t] = p.get(t, 0) + 1
                    if (u := fit(room - t)) is not None:
                        p[u] = p.get(u, 0) + 1
                add(p)
    ranked = sorted(found.values(), key=lambda p: (capacity - sum(s * m for s, m in p.items()), sorted(p.items())))
    return ranked[:most]


def nnls(index: np.ndarray, value: np.ndarray, b: np.ndarray, steps: int = 400) -> np.ndarray:
    """min |a x - b| over x >= 0 by accelerated projected gradients. Column j of the sparse ``a`` holds ``value[j]`` in the
    rows ``index[j]``."""
    if not index.size:
        return np.zeros(len(index))
    flat = index.ravel()
    times = lambda x: np.bincount(flat, (value * x[:, None]).ravel(), len(b))
    back = lambda r: (value * r[index]).sum(1)
    v = np.ones(len(index))
    for _ in range(20):  # the largest eigenvalue of a'a bounds the step
        v = back(times(v))
        norm = np.linalg.norm(v)
        v /= norm or 1.0
    step, x = 1.0 / (norm * 1.05 or 1.0), np.zeros(len(index))
    y, t = x, 1.0
    for _ in range(steps):
        new = np.maximum(0.0, y - step * back(times(y) - b))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


def plan_containers(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows ``(size, start, stop, base, per)``: the items of ``size`` with rank in [start, stop) go to container
    ``base + (rank - start) // per``. Also the number of containers."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for s, n in histogram.items():
        left[s] = n
    used, rows, base = np.zeros_like(left), [], 0

    def repeat(p: dict[int, int], times: int) -> None:
        nonlocal base
        for s, m in p.items():
            rows.append((s, int(used[s]), int(used[s] + m * times), base, m))
            used[s] += m * times
            left[s] -= m * times
        base += times

    sizes = [s for s in range(1, capacity + 1) if left[s]]
    choice = patterns(sizes, left, capacity)
    if choice:
        index = {s: i for i, s in enumerate(sizes)}
        wide = max(map(len, choice))
        rows_of, value = np.zeros((len(choice), wide), np.int64), np.zeros((len(choice), wide))
        for j, p in enumerate(choice):
            for i, (s, m) in enumerate(p.items()):
                rows_of[j, i], value[j, i] = index[s], m
        # large items count by their size: what is left over should be small
        scale = np.sqrt(np.array(sizes, dtype=np.float64))
        fitted = nnls(rows_of, value * scale[rows_of], left[sizes] * scale)
        for j in np.argsort(-fitted, kind="stable"):
            p = choice[j]
            times = min(int(fitted[j]), *(int(left[s] // m) for s, m in p.items()))
            if times > 0:
                repeat(p, times)
    # the residual: largest size first, completed by best fit; each step uses up at least one size
    have = [s for s in sizes if left[s]]
    while have:
        p, room, at = {}, capacity, len(have) - 1
        while room and at >= 0:
            s = have[at]
            m = min(room // s, int(left[s]) - p.get(s, 0))
            # all but one of the repeats of a size, so that the last place can still be an exact fit
            if m:
                p[s] = p.get(s, 0) + (m if m == 1 or not p else 1)
                room -= s * (m if m == 1 or len(p) == 1 and p[s] == m else 1)
            at = min(at if left[s] > p.get(s, 0) else at - 1, bisect_right(have, room) - 1)
        repeat(p, min(int(left[s] // m) for s, m in p.items()))
        have = [s for s in have if left[s]]
    return rows, base


def pack_items(items: DataFrame, capacity: int = CAPACITY, *, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """``key, piece_no, piece_start, piece_size, item_size, container_id`` for every row of ``items``.

    An item above ``capacity`` is cut into full pieces, each a container of its own, and a remainder that is packed
    like any item. Items of size 0 take no space and are dealt over the containers. Null sizes count as 0; a null key
    is a key; repeated rows are packed each. An empty table has no containers.
    """
    spark = items.sparkSession
    scratch = Scratch(spark, "packing")
    items = items.select(items[key].alias("key"), F.greatest(F.coalesce(items[size], F.lit(0)), F.lit(0)).cast("long").alias("n"))
    last = F.greatest(F.ceil(F.col("n") / F.lit(capacity)) - 1, F.lit(0)).cast("int")
    pieces = items.select("key", "n", F.explode(F.sequence(F.lit(0), last)).alias("no")).select(
        "key", "n", "no", F.least(F.lit(capacity), F.col("n") - F.col("no") * F.lit(capacity)).cast("int").alias("s"))
    pieces = scratch.table(pieces, "pieces")
    histogram = {r["s"]: r["m"] for r in pieces.groupBy("s").agg(F.count(F.lit(1)).alias("m")).collect()}  # at most capacity + 1 rows
    buckets = [(s, -(-m // BUCKET_ROWS)) for s, m in histogram.items()]
    many = sum(m for _, m in buckets)
    split = F.broadcast(spark.createDataFrame(buckets, "s int, buckets int"))
    pieces = pieces.join(split, "s").withColumn("b", F.pmod(F.xxhash64("key", "no"), F.col("buckets")).cast("int")).drop("buckets")
    before = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.groupBy("s", "b").agg(F.count(F.lit(1)).alias("m")).withColumn("o", F.coalesce(F.sum("m").over(before), F.lit(0)))
    offsets = broadcast_if(offsets.select("s", "b", "o"), many, SMALL)
    empty = histogram.pop(0, 0)
    rows, containers = plan_containers(histogram, capacity)
    if empty:
        containers = max(containers, 1)
        rows += [(0, 0, empty, 0, 0)]
    plan = spark.createDataFrame(rows, _PLAN)
    in_bucket = Window.partitionBy("s", "b").orderBy(F.col("key").asc_nulls_first(), "no")
    ranked = pieces.withColumn("r", F.row_number().over(in_bucket) - 1).join(offsets, ["s", "b"]).withColumn("rank", F.col("o") + F.col("r"))
    placed = ranked.join(F.broadcast(plan), (F.col("s") == F.col("size")) & (F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("stop")))
    container = F.when(F.col("per") == 0, F.col("rank") % F.lit(max(containers, 1))).otherwise(
        F.col("base") + F.floor((F.col("rank") - F.col("start")) / F.greatest("per", F.lit(1))))
    return placed.select(
        F.col("key").alias(key), F.col("no").alias("piece_no"), (F.col("no") * F.lit(capacity)).cast("long").alias("piece_start"),
        F.col("s").alias("piece_size"), F.col("n").alias("item_size"), container.cast("long").alias("container_id"))


def p8_containers(spark, sf_dir: str) -> DataFrame:
    """Every document, or each piece of one above the capacity, with its container."""
    return pack_items(count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def p8_found(spark, sf_dir: str) -> DataFrame:
    cut = pack_items(count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))).where(F.col("item_size") > CAPACITY)
    return cut.where(F.col("piece_no") == 0).select("doc_id")


QUERIES = {"p8_found": p8_found, "p8_containers": p8_containers}
SQL: dict[str, str] = {}
