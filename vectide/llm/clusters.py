"""Clusters of mutually similar records by reciprocal-nearest-neighbour average linkage.

A forest on 8-bit vectors links candidates; connected components of these links divide the work, as linkage never
merges across components. Inside a component every round merges pairs of clusters that are each other's best
neighbour among all its clusters, until the best average falls below the threshold. The average cosine of two clusters is
the product of their means of unit vectors, so no list of pairs is ever kept. Components beyond
``local_most`` rows run the same rounds as Spark joins until what can still merge fits one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectide.llm import forest as rp
from vectide.llm.components import components
from vectide.plans.scratch import Scratch, broadcast_if

DIM = 96
#: Two clusters merge while their average cosine is at least this.
MERGE_AT = 0.75
#: Error allowed for cosines of 8-bit vectors.
COARSE = 0.012
#: Components up to so many different vectors are clustered in one task (about 60 MB of vectors and similarity blocks).
LOCAL_MOST = 20_000
#: Rows of a block where all rows of a larger component are compared (two blocks a task).
BLOCK_ROWS = 16_384

_OUT = "id long, cluster_id long, fit double, inside double, outside double"


def similarity_clusters(
    records: DataFrame, *, id: str = "id", vector: str = "vector", dim: int = DIM, merge_at: float = MERGE_AT,
    trees: int = 6, leaf_rows: int = rp.LEAF_ROWS, local_most: int = LOCAL_MOST, typical: int = 3,
) -> DataFrame:
    """``cluster_id, id, size, typical_rank, inside, outside`` of every record that shares a cluster.

    ``cluster_id`` is the smallest id of the cluster, ``size`` counts its records, ``typical_rank`` is 1..``typical`` for
    the records closest to the cluster's mean (null for others; ties by id). ``inside`` is the smallest cosine between
    two members, ``outside`` the largest between a member and a record of its component outside (-1 if there is none), both exact,
    except that in components beyond ``local_most`` an ``inside`` of 0.8 or more may be a lower bound.
    Copies of a vector belong to the cluster of that vector; a vector that only has copies is a cluster of them. Records
    whose nearest cluster is below the threshold, and rows that ``forest.usable`` leaves out, are in no cluster.
    """
    spark = records.sparkSession
    scratch = Scratch(spark, "clusters")
    reps, copies, n_copies = rp.collapse(rp.usable(records, id, vector, dim), scratch)
    forest = rp.learn(reps, count := reps.count(), dim, trees=trees, leaf_rows=leaf_rows)
    routed = rp.route(reps, forest, dim, member=True, query=True, probes=trees, coarse=True)
    stars = scratch.table(_leaf_stars(routed, dim, merge_at - COARSE, leaf_rows), "stars")
    # a record's roots in several trees are one component; only edges between roots go through the rounds
    home = stars.groupBy("id").agg(F.min("root").alias("m"), F.collect_set("root").alias("roots"))
    home = scratch.table(home, "home")
    between = home.select(F.col("m").alias("b"), F.explode("roots").alias("a"))
    labels = scratch.table(components(between, scratch), "labels")
    member = home.join(labels, home["m"] == labels["a"]).select("id", "label")
    weights = copies.groupBy("rep").agg(F.count(F.lit(1)).alias("extra")) if n_copies else None
    if n_copies:
        weights = broadcast_if(scratch.table(weights, "weights"), n_copies, rp.SMALL)
        alone = weights.select(F.col("rep").alias("id")).join(home.select("id"), "id", "left_anti")
        member = member.unionByName(alone.select("id", F.col("id").alias("label")))
    member = scratch.table(member, "member")
    scratch.drop(stars, home)
    giant = member.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > local_most)
    giant = scratch.table(giant, "giant")
    giants = giant.count()  # at most all records / local_most
    rows = reps.join(member, "id")
    rows = rows.join(weights, rows["id"] == weights["rep"], "left").drop("rep") if n_copies else rows.withColumn("extra", F.lit(0))
    rows = rows.select("label", "id", "vector", (F.coalesce("extra", F.lit(0)) + 1).cast("long").alias("w"))
    if giants:
        rows = scratch.table(rows, "rows")
        small = rows.join(broadcast_if(giant.select("label"), giants, rp.SMALL), "label", "left_anti")
        large = rows.join(broadcast_if(giant.select("label"), giants, rp.SMALL), "label", "left_semi")
        done = _local(small, dim, merge_at).unionByName(_rounds(large, dim, merge_at, scratch, local_most))
    else:
        done = _local(rows, dim, merge_at)
    if n_copies:
        done = scratch.table(done, "done")
        twins = broadcast_if(copies.withColumnRenamed("id", "twin"), n_copies, rp.SMALL)
        more = done.join(twins, done["id"] == twins["rep"]).select(F.col("twin").alias("id"), *done.columns[1:])
        done = done.unionByName(more)
    return _describe(done, typical)


def _describe(done: DataFrame, typical: int) -> DataFrame:
    """Sizes and the most typical members, aggregated with map-side combining and joined back."""
    place = Window.partitionBy("cluster_id").orderBy(F.desc("fit"), "id")
    best = done.withColumn("typical_rank", F.row_number().over(place)).where(F.col("typical_rank") <= typical)
    best = best.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("typical_rank", "id"))).alias("best"))
    size = done.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), F.min("inside").alias("inside"), F.max("outside").alias("outside"))
    about = size.where("size > 1").join(best, "cluster_id")
    rank = F.array_position(F.transform("best", lambda x: x["id"]), F.col("id"))
    return done.select("cluster_id", "id").join(about, "cluster_id").select(
        "cluster_id", "id", "size", F.when(rank > 0, rank).cast("int").alias("typical_rank"), "inside", "outside")


def _leaf_stars(routed: DataFrame, dim: int, at: float, leaf_rows: int) -> DataFrame:
    """``id, root``: in each leaf, every linked row with the smallest id that it is connected to there."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        u = rp.unit(rp.matrix(table.column("vector"), dim).astype(np.float32))
        out_id, out_root = [], []
        for rows in rp._parts(u, 2 * leaf_rows):
            rows = rows[np.argsort(ids[rows], kind="stable")]
            x = u[rows]
            root = np.full(len(rows), -1)
            for i in range(len(rows)):  # ascending ids: an unseen row is the smallest of its part
                if root[i] >= 0:
                    continue
                root[i] = i
                front = np.array([i])
                while len(front):
                    open_ = np.flatnonzero(root < 0)
                    if not len(open_):
                        break
                    hit = np.zeros(len(open_), bool)
                    for k in range(0, len(front), 512):
                        hit |= (x[front[k : k + 512]] @ x[open_].T >= at).any(0)
                    front = open_[hit]
                    root[front] = i
            linked = np.bincount(root, minlength=len(rows))[root] > 1
            out_id.append(ids[rows[linked]])
            out_root.append(ids[rows[root[linked]]])
        cat = lambda v: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64))
        return pa.table({"id": cat(out_id), "root": cat(out_root)})

    return routed.groupBy("leaf").applyInArrow(run, "id long, root long")


def partners(q: np.ndarray, m: np.ndarray, q_ids: np.ndarray, ids: np.ndarray, dead: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``q`` the id of the row of ``m`` with the largest product, of all but itself and the ``dead``, and
    the product. Of equal ones (1e-12) the id next to its own by exclusive or: equal rows so form many mutual pairs."""
    best, value = np.empty(len(q), np.int64), np.empty(len(q))
    for s in range(0, len(q), 256):
        own = q_ids[s : s + 256]
        c = q[s : s + 256] @ m.T
        c[own[:, None] == ids[None, :]] = -2
        if dead is not None:
            c[:, dead] = -2
        top = c.max(1)
        tie = c >= top[:, None] - 1e-12
        at = tie.argmax(1)
        many = np.flatnonzero(tie.sum(1) > 1)
        at[many] = np.where(tie[many], own[many][:, None] ^ ids[None, :], np.iinfo(np.int64).max).argmin(1)
        best[s : s + 256], value[s : s + 256] = ids[at], top
    return best, value


def linkage(u: np.ndarray, w: np.ndarray, at: float) -> np.ndarray:
    """Cluster number (a row's index) of each row. Rounds: find best partners among all clusters, merge the mutual pairs.

    An average with a merged cluster is never above the larger of the two before. So a partner stays the best one until it
    merges itself, a cluster without a partner of at least ``at`` never gets one, and only the merged clusters and those
    that their search leads to have to be searched for again."""
    n = len(u)
    own, size, mean, pool = np.arange(n), w.astype(np.float64), u.astype(np.float64), np.arange(n)
    live, known, best, value, place = np.ones(n, bool), np.zeros(n, bool), np.full(n, -1), np.full(n, -2.0), np.arange(n)
    todo = pool
    while live.any():
        if live.sum() < 0.7 * len(pool):
            keep = live[pool]
            pool, mean = pool[keep], mean[keep]
            place[pool] = np.arange(len(pool))
        best[todo], value[todo] = partners(mean[place[todo]], mean, todo, pool, np.flatnonzero(~live[pool]))
        known[todo] = True
        live[todo[value[todo] < at - 1e-12]] = False
        todo = todo[live[todo]]
        c = np.flatnonzero(known & live)
        a = c[known[best[c]] & live[best[c]] & (best[best[c]] == c) & (c < best[c])]
        if not len(a):
            step = np.unique(best[todo])
            for _ in range(64):
                if not known[step].any():
                    break
                step = np.unique(np.where(known[step], best[step], step))
            todo = step[~known[step] & live[step]]
            if not len(todo):
                todo = np.flatnonzero(live & ~known)
            if len(todo) or not live.any():
                continue
            c = np.flatnonzero(live & live[best])  # a ring of averages that differ by rounding only
            if not len(c):
                break
            a = c[[value[c].argmax()]]
        low, high = np.minimum(a, best[a]), np.maximum(a, best[a])
        total = size[low] + size[high]
        mean[place[low]] = (mean[place[low]] * size[low, None] + mean[place[high]] * size[high, None]) / total[:, None]
        size[low], live[high] = total, False
        merged = np.zeros(n, bool)
        merged[low] = merged[high] = True
        known &= ~(merged | merged[best])
        to = np.arange(n)
        to[high] = low
        own = to[own]
        todo = low
    return own


def _local(rows: DataFrame, dim: int, at: float) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids = table.column("id").to_numpy()
        x = rp.matrix(table.column("vector"), dim).astype(np.float64)
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        inside, outside = np.ones(len(u)), np.full(len(u), -1.0)
        whole = u @ u.T if len(u) <= 2048 else None
        # if all pairs are that close, so are all averages on the way to one cluster
        own = np.zeros(len(u), int) if whole is not None and whole.min() > at + 1e-9 else linkage(u, table.column("w").to_numpy(), at)
        for s in range(0, len(u), 512):
            c = u[s : s + 512] @ u.T if whole is None else whole[s : s + 512]
            same = own[s : s + 512, None] == own[None, :]
            inside[s : s + 512] = np.where(same, c, 1.0).min(1)
            outside[s : s + 512] = np.where(same, -1.0, c).max(1)
        mean = np.zeros_like(u)
        np.add.at(mean, own, u)
        fit = np.einsum("ij,ij->i", u, mean[own]) / np.maximum(np.linalg.norm(mean[own], axis=1), 1e-300)
        return pa.table({"id": ids, "cluster_id": ids[own], "fit": np.round(fit, 9), "inside": np.round(inside, 6), "outside": np.round(outside, 6)})

    return rows.groupBy("label").applyInArrow(run, _OUT)


def _dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0).cast("double"), lambda s, x: s + x)


def _unit_col(v: str):
    norm = F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0).cast("double"), lambda s, x: s + x))
    return F.transform(v, lambda x: x.cast("double") / norm)


def _best_partners(nodes: DataFrame, dim: int, block: int = BLOCK_ROWS) -> DataFrame:
    """``c, b, sim``: each cluster's best partner of all clusters of its component, compared in pairs of blocks."""

    def run(table: pa.Table) -> pa.Table:
        mean = table.column("mean").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        c = table.column("c").to_numpy()
        a, b = _sides(table)
        sides = [(a, b)] if np.array_equal(a, b) else [(a, b), (b, a)]
        got = [(c[x], *partners(mean[x], mean[y], c[x], c[y])) for x, y in sides if len(x) and len(y)]
        cat = lambda k, kind: np.concatenate([np.zeros(0, kind), *(g[k] for g in got)])
        return pa.table({"c": cat(0, np.int64), "b": cat(1, np.int64), "sim": np.round(cat(2, np.float64), 12)})

    found = _paired(nodes.select("label", "c", "mean"), "label", "c", block).groupBy("label", "b").applyInArrow(run, "c long, b long, sim double")
    found = found.groupBy("c").agg(F.max(F.struct("sim", (-F.col("c").bitwiseXOR(F.col("b"))).alias("near"), "b")).alias("m"))
    return found.select("c", "m.b", "m.sim")


def _rounds(rows: DataFrame, dim: int, at: float, scratch: Scratch, local_most: int) -> DataFrame:
    """The rounds as joins, for components too large for a task, until the clusters that can still merge fit one."""
    unit = rows.select("label", "id", "w", _unit_col("vector").alias("u"))
    unit = scratch.table(unit, "unit")
    nodes = unit.select("label", F.col("id").alias("c"), F.col("u").alias("mean"), F.col("w").cast("double").alias("size"))
    own = unit.select("id", F.col("id").alias("c"))

    def moved(df: DataFrame, merge: DataFrame) -> DataFrame:
        m = df.join(merge, df["c"] == merge["from"], "left")
        return m.withColumn("c", F.coalesce("to", "c")).drop("from", "to")

    while (nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0) > local_most:
        best = scratch.table(_best_partners(nodes, dim).where(F.col("sim") >= at - 1e-12), "best")
        back = best.select(F.col("b").alias("c"), F.col("c").alias("b"))
        merge = scratch.table(best.join(back, ["c", "b"]).where("c < b").select(F.col("b").alias("from"), F.col("c").alias("to")), "merge")
        if not merge.limit(1).count():  # none left, or a ring of averages that differ by rounding only
            first = best.orderBy(F.desc("sim"), "c").limit(1)
            merge = scratch.table(first.select(F.greatest("c", "b").alias("from"), F.least("c", "b").alias("to")), "merge")
        kept = moved(nodes.join(best.select("c"), "c", "left_semi"), merge)
        mean = F.array(*[F.sum(F.col("mean")[x] * F.col("size")) / F.sum("size") for x in range(dim)])
        nodes = scratch.table(kept.groupBy("label", "c").agg(mean.alias("mean"), F.sum("size").alias("size")), "nodes")
        own = scratch.table(moved(own, merge), "own")

    def finish(table: pa.Table) -> pa.Table:
        table = table.sort_by("c")
        c = table.column("c").to_numpy()
        mean = table.column("mean").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        return pa.table({"from": c, "to": c[linkage(mean, table.column("size").to_numpy(), at)]})

    own = scratch.table(moved(own, nodes.groupBy("label").applyInArrow(finish, "from long, to long")), "own")
    sums = F.array(*[F.sum(F.col("u")[x] * F.col("w")) for x in range(dim)])
    nodes = unit.join(own, "id").groupBy("c").agg(sums.alias("sum"))
    leave = _outside(rows.select("label", "id", "vector").join(own, "id"), dim)
    fit = unit.join(own, "id").join(nodes.select("c", _unit_col("sum").alias("mean")), "c")
    fit = scratch.table(fit.select("id", "c", "u", F.round(_dot("u", "mean"), 9).alias("fit")), "fit")
    inside = _inside(fit, dim, scratch)
    return fit.join(inside, "c", "left").join(leave, "c", "left").select(
        "id", F.col("c").alias("cluster_id"), "fit", F.coalesce("inside", F.lit(1.0)).alias("inside"), F.coalesce("outside", F.lit(-1.0)).alias("outside"))


def _paired(rows: DataFrame, by: str, key: str, block: int) -> DataFrame:
    """``rows`` cut into blocks of about ``block`` rows within each ``by``, once for each pair ``b`` (lo, hi) of blocks
    that their block ``own`` belongs to: the rows of a pair come together in one task."""
    slots = rows.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    rows = rows.join(slots, by).withColumn("own", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("own")).alias("lo"), F.greatest(x, F.col("own")).alias("hi")))
    return rows.withColumn("b", F.explode(pair)).drop("blocks")


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of a pair's two blocks; the same ones twice if a block meets itself."""
    own, pair = table.column("own").to_numpy(), table.column("b").combine_chunks()
    return np.flatnonzero(own == pair.field("lo")[0].as_py()), np.flatnonzero(own == pair.field("hi")[0].as_py())


def _outside(rows: DataFrame, dim: int, block: int = BLOCK_ROWS) -> DataFrame:
    """``c, outside``: the largest cosine between a member of a cluster and any row of the component that is in another.
    All rows of a component are compared, block by block, so the work grows with the square of its size."""

    def run(table: pa.Table) -> pa.Table:
        x = rp.matrix(table.column("vector"), dim).astype(np.float64)
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        c = table.column("c").to_numpy()
        a, b = _sides(table)
        most = np.full(len(u), -1.0)
        for s in range(0, len(a) if len(b) else 0, 512):
            i = a[s : s + 512]
            cos = np.where(c[i][:, None] == c[b][None, :], -1.0, u[i] @ u[b].T)
            most[i] = np.maximum(most[i], cos.max(1))
            most[b] = np.maximum(most[b], cos.max(0))
        cluster, at = np.unique(c, return_inverse=True)
        out = np.full(len(cluster), -1.0)
        np.maximum.at(out, at, most)
        return pa.table({"c": cluster, "outside": np.round(out, 6)})

    pairs = _paired(rows.select("label", "id", "c", "vector"), "label", "id", block)
    return pairs.groupBy("label", "b").applyInArrow(run, "c long, outside double").groupBy("c").agg(F.max("outside").alias("outside"))


def _inside(fit: DataFrame, dim: int, scratch: Scratch, bar: float = 0.8, block: int = BLOCK_ROWS) -> DataFrame:
    """``c, inside``: the smallest cosine in each cluster where it is below ``bar``, else a lower bound of at least
    ``bar``. Two members at angles p and q from the mean are at most p + q apart, so only members that could pass
    acos(bar) together with the cluster's widest are compared, in blocks; no pairs are emitted."""
    angle = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("fit"))))
    rows = fit.select("id", "c", "u", angle.alias("p"))
    wide = rows.groupBy("c").agg(F.max("p").alias("most"))
    limit = float(np.arccos(bar))
    bound = wide.select("c", F.greatest(F.lit(bar), F.cos(2 * F.col("most"))).alias("inside"))
    doubt = rows.join(wide.where(2 * F.col("most") > limit), "c").where(F.col("p") + F.col("most") > limit - 1e-6)
    doubt = _paired(doubt.select("c", "id", "u"), "c", "id", block).drop("id")

    def run(table: pa.Table) -> pa.Table:
        x = table.column("u").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        a, b = (x[side] for side in _sides(table))
        least = min([1.0, *((a[s : s + 512] @ b.T).min() for s in range(0, len(a), 512) if len(b))])
        return pa.table({"c": table.column("c").slice(0, 1), "inside": [float(round(least, 6))]})

    seen = doubt.groupBy("c", "b").applyInArrow(run, "c long, inside double").groupBy("c").agg(F.min("inside").alias("seen"))
    return bound.join(seen, "c", "left").select("c", F.coalesce(F.when(F.col("seen") < bar, F.col("seen")), "inside").alias("inside"))


def p3_clusters(spark, sf_dir: str) -> DataFrame:
    """All clusters with size, most typical members and cohesion."""
    return similarity_clusters(spark.read.parquet(f"{sf_dir}/records.parquet").select("id", "vector"))


def p3_found(spark, sf_dir: str) -> DataFrame:
    """Clusters that are tight and set apart; ``inside`` and ``outside`` are the exact check."""
    tight = (F.col("size") >= 3) & (F.col("inside") >= 0.80) & (F.col("outside") < 0.75)
    return p3_clusters(spark, sf_dir).where(tight).select("cluster_id", "id")


#: By definition instead of linkage: records with the same neighbours at 0.75 (themselves included), all of them 0.80 close.
P3_SQL = """
WITH r AS (SELECT id, vector::DOUBLE[] AS v FROM records WHERE list_max(list_transform(vector, lambda x: abs(x))) > 0),
p AS (SELECT * FROM (SELECT a.id AS a, b.id AS b, CASE WHEN a.id = b.id THEN 1 ELSE round(list_cosine_similarity(a.v, b.v), 6) END AS c FROM r a, r b) WHERE c >= 0.75),
n AS (SELECT a, list_sort(list(b)) AS near, min(c) AS least FROM p GROUP BY a),
k AS (SELECT near FROM n GROUP BY near HAVING count(*) = len(near) AND count(*) >= 3 AND min(least) >= 0.80)
SELECT near[1] AS cluster_id, unnest(near) AS id FROM k
"""

QUERIES = {"p3_found": p3_found, "p3_clusters": p3_clusters}
SQL = {"p3_found": P3_SQL}
