from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.llm import forest as rp
from vectide.llm.clusters import linkage, similarity_clusters
from vectide.llm.components import components
from vectide.llm.diverse import farthest_first, from_earlier, varied_subset
from vectide.llm.knn import nearest
from vectide.plans.scratch import Scratch

DIM = 12


def blobs(groups, seed=0, spread=0.12, dim=DIM):
    rng = np.random.default_rng(seed)
    out = []
    for n in groups:
        c = rng.normal(size=dim)
        c /= np.linalg.norm(c)
        out += [(c + spread / dim**0.5 * rng.normal(size=dim)) * rng.uniform(0.5, 3) for _ in range(n)]
    return np.array(out, np.float32)


def frame(spark, x, ids=None, extra=()):
    rows = [(int(i), v.tolist(), "clash") for i, v in zip(ids if ids is not None else range(1, len(x) + 1), x)] + [(*e, "clash") for e in extra]
    return spark.createDataFrame(rows, "id long, vector array<float>, leaf string")


DIRT = [(None, [1.0] * DIM), (9001, None), (9002, []), (9003, [0.0] * DIM), (9004, [1.0] * 3), (9005, [float("nan")] * DIM), (9006, [float("inf")] * DIM)]


def brute(x, ids, k, least):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    c = np.round(u @ u.T, 6)
    out = {}
    for i, a in enumerate(ids):
        order = sorted((-c[i, j], ids[j]) for j in range(len(ids)) if j != i and c[i, j] >= least)[:k]
        out[a] = [(b, -s) for s, b in order]
    return out


def lists(df):
    out = {}
    for r in df.orderBy("id", "rank").collect():
        out.setdefault(r["id"], []).append((r["other"], r["cosine"]))
    return out


def test_one_leaf_is_exact(spark):
    x = blobs([40, 30, 3, 1])
    ids = list(range(5, 5 + 3 * len(x), 3))
    got = lists(nearest(frame(spark, x, ids, DIRT), 5, 0.5, dim=DIM))
    want = {a: v for a, v in brute(x, ids, 5, 0.5).items() if v}
    assert {a: [b for b, _ in v] for a, v in got.items()} == {a: [b for b, _ in v] for a, v in want.items()}
    assert all(abs(s - t) < 1.1e-6 for a in got for (_, s), (_, t) in zip(got[a], want[a]))


def test_a_third_are_copies(spark):
    x = blobs([30, 20])
    x = np.concatenate([x, np.repeat(x[:1], 25, 0), np.repeat(x[40:41] * 2, 3, 0)])  # copies; scaled ones tie with cosine 1
    ids = random.Random(0).sample(range(1, 1000), len(x))
    got = lists(nearest(frame(spark, x, ids), 4, 0.6, dim=DIM))
    want = {a: v for a, v in brute(x, ids, 4, 0.6).items() if v}
    assert {a: [b for b, _ in v] for a, v in got.items()} == {a: [b for b, _ in v] for a, v in want.items()}


def test_many_scaled_copies_rank_by_id(spark):
    x = blobs([20])
    x = np.concatenate([x, x[:1] * np.random.default_rng(1).uniform(0.5, 3, (300, 1))]).astype(np.float32)
    ids = random.Random(0).sample(range(1, 1000), len(x))
    got = lists(nearest(frame(spark, x, ids), 4, 0.6, dim=DIM))
    assert {a: [b for b, _ in v] for a, v in got.items()} == {a: [b for b, _ in v] for a, v in brute(x, ids, 4, 0.6).items()}


def test_planes_do_not_part_scaled_copies():
    for seed in range(10):
        scale = np.random.default_rng(1).uniform(0.5, 3, (500, 1)).astype(np.float32)
        u = rp.unit(np.concatenate([blobs([300], seed=seed, spread=2), blobs([1], seed=50 + seed) * scale]))
        assert len(set(rp.Forest([rp.fit_tree(u, 100, 7)]).search(u, 1)[300:, 0].tolist())) == 1


def test_forest_recall_and_probes(spark):
    x = blobs([25] * 60, seed=3)
    df = frame(spark, x)
    want = brute(x, list(range(1, len(x) + 1)), 10, 0.8)
    total = sum(map(len, want.values()))
    for kw in ({}, {"probes": 6}):
        got = lists(nearest(df, 10, 0.8, dim=DIM, leaf_rows=100, **kw))
        hit = sum(len({b for b, _ in v} & {b for b, _ in want[a]}) for a, v in got.items())
        assert hit / total >= 0.9
    part = lists(nearest(df, 10, 0.8, dim=DIM, leaf_rows=100, queries=F.col("id") % 50 == 0, probes=8))
    assert set(part) <= {i for i in range(1, len(x) + 1) if i % 50 == 0}
    hit = sum(len({b for b, _ in v} & {b for b, _ in want[a]}) for a, v in part.items())
    assert hit / sum(len(want[a]) for a in part) >= 0.9


def costs(f: rp.Forest, x: np.ndarray) -> tuple[np.ndarray, list[set[int]]]:
    """Of each leaf, by walking all trees: its cost to one row, and the planes on the path to it."""
    cost, path = np.zeros(f.first[-1]), [set() for _ in range(f.first[-1])]
    todo = [(int(r), 0.0, set()) for r in f.roots]
    while todo:
        node, c, above = todo.pop()
        if node < 0:
            cost[-1 - node], path[-1 - node] = c, above
            continue
        m = float(x @ f.normals[node] - f.offsets[node])
        todo += [(int(f.below[node]), max(c, m), above | {node}), (int(f.above[node]), max(c, -m), above | {node})]
    return cost, path


def test_queue_pops_the_nearest_leaves_and_looks_at_no_other_node():
    x = rp.unit(blobs([20] * 20, seed=5))
    f = rp.fit_forest(x, 4000, trees=3, leaf_rows=200)
    got = f.search(x, 9)
    assert all(len(set(p)) == 9 for p in got.tolist())
    for i in range(0, len(x), 37):
        cost, path = costs(f, x[i])
        along = cost[got[i]]
        assert np.allclose(along, np.sort(cost)[:9], atol=1e-6) and (along[:3] == 0).all()
        assert [int(np.searchsorted(f.first, leaf, "right")) for leaf in got[i, :3]] == [1, 2, 3]
        popped = set().union(*(path[leaf] for leaf in got[i]))
        assert len(popped) < len(f.offsets)
        blind = rp.Forest(f.trees)
        blind.normals[[p for p in range(len(f.offsets)) if p not in popped]] = np.nan
        assert (blind.search(x[i : i + 1], 9) == got[i]).all()
    small = rp.fit_forest(x[:3], 3, trees=2)
    assert (small.search(x[:3], 5)[:, 2:] == -1).all()


def test_more_probes_than_trees_find_more(spark):
    """The rows of the search come through the queue: leaves beyond a row's own ones add neighbours."""
    x = blobs([25] * 60, seed=3, spread=0.5)
    want = brute(x, list(range(1, len(x) + 1)), 10, 0.6)

    def recall(probes):
        got = lists(nearest(frame(spark, x), 10, 0.6, dim=DIM, leaf_rows=100, trees=2, probes=probes))
        return sum(len({b for b, _ in v} & {b for b, _ in want[a]}) for a, v in got.items()) / sum(map(len, want.values()))

    assert recall(2) < recall(6) <= 1
    with pytest.raises(ValueError):
        nearest(frame(spark, x), 10, dim=DIM, trees=3, probes=2)


def test_large_leaves_are_split_before_rows_move(spark, monkeypatch):
    """A sample that allows two leaves a tree: the subtrees are fitted in parallel and no leaf outgrows twice its size."""
    monkeypatch.setattr(rp, "MIN_SAMPLE_LEAF", 32)
    x = blobs([40] * 100, seed=8, spread=0.5)
    df = frame(spark, x).select("id", "vector")
    f = rp.learn(df, len(x), DIM, trees=2, leaf_rows=200, sample_rows=64)
    assert f.first[-1] > 20
    held = rp.route(df, f, DIM, member=True, query=False, probes=0, coarse=False).groupBy("leaf").count().collect()
    assert sum(r["count"] for r in held) == 2 * len(x) and max(r["count"] for r in held) <= 400
    cost, path = costs(f, x[0])
    assert all(path)  # each leaf hangs under a plane


def test_repeated_ids_and_empty(spark):
    x = blobs([4])
    df = frame(spark, np.concatenate([x, x[:2]]), [1, 2, 3, 4, 1, 2])
    assert sorted(lists(nearest(df, 9, 0.0, dim=DIM))) == [1, 2, 3, 4]
    both = frame(spark, np.concatenate([x, -x[:1]]), [1, 2, 3, 4, 1])  # one id with two vectors
    assert sorted({r["id"] for r in nearest(both, 9, -1.0, dim=DIM).collect()}) == [1, 2, 3, 4]
    assert nearest(df.limit(0), 3, dim=DIM).isEmpty()
    assert similarity_clusters(df.limit(0), dim=DIM).isEmpty() and varied_subset(df.limit(0).withColumn("metadata", F.create_map()).withColumn("metadata", F.col("metadata").cast("map<string,string>")), 5, dim=DIM).isEmpty()


def test_components_of_paths_and_stars(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (300, 300), (None, 4), (5, None), (2, 1)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["a"]: r["label"] for r in components(df, Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {300: 300}
    assert components(df.limit(0), Scratch(spark, "t")).isEmpty()


@pytest.mark.parametrize("most", [20_000, 10])
def test_clusters_of_blobs(spark, most):
    sizes = [30, 12, 3, 2, 1]
    x = blobs(sizes, seed=8, dim=48)
    x = np.concatenate([x, np.repeat(x[:1], 20, 0), np.repeat(blobs([1], seed=99, dim=48), 4, 0)])  # copies in a blob; a blob of copies
    ids = [7 * i + 3 for i in range(len(x))]
    dirt = [(None, [1.0] * 48), (9001, None), (9003, [0.0] * 48), (9004, [1.0] * 3)]
    rows = similarity_clusters(frame(spark, x, ids, dirt), dim=48, leaf_rows=30, local_most=most).collect()
    where = np.repeat(range(len(sizes)), sizes).tolist() + [0] * 20 + [9] * 4
    want = {}
    for i, g in zip(ids, where):
        want.setdefault(g, []).append(i)
    want = {i: (min(v), len(v)) for v in want.values() if len(v) > 1 for i in v}
    assert {r["id"]: (r["cluster_id"], r["size"]) for r in rows} == want
    u = x.astype(np.float64) / np.linalg.norm(x, axis=1, keepdims=True)
    for r in rows:
        m = [i for i, k in enumerate(ids) if want.get(k, (0,))[0] == r["cluster_id"]]
        least = round(float((u[m] @ u[m].T).min()), 6)
        assert r["inside"] == pytest.approx(least, abs=2e-6) or (most == 10 and 0.8 <= r["inside"] <= least + 1e-6)
        assert r["outside"] == -1
    typical = {}
    for r in rows:
        if r["typical_rank"]:
            typical.setdefault(r["cluster_id"], []).append(r["typical_rank"])
    assert all(sorted(v) == list(range(1, min(3, want[c][1]) + 1)) for c, v in typical.items())


@pytest.mark.parametrize("most", [20_000, 10])
def test_outside_of_dense_clusters(spark, most):
    """Two clusters whose members have their 16 best inside, with single cosines of 0.75 and more between them."""
    rng = np.random.default_rng(3)
    a, b = np.eye(48)[0], 0.74 * np.eye(48)[0] + (1 - 0.74**2) ** 0.5 * np.eye(48)[1]
    x = np.array([c + 0.15 / 48**0.5 * rng.normal(size=48) for c in (a, b) for _ in range(25)], np.float32)
    u = x.astype(np.float64) / np.linalg.norm(x, axis=1, keepdims=True)
    want = round(float((u[:25] @ u[25:].T).max()), 6)
    assert (u[:25] @ u[25:].T).mean() < 0.75 <= want
    rows = similarity_clusters(frame(spark, x), dim=48, local_most=most).collect()
    assert {(r["cluster_id"], r["size"]) for r in rows} == {(1, 25), (26, 25)}
    assert all(r["outside"] == pytest.approx(want, abs=1.1e-6) for r in rows)


def test_rounds_equal_pairwise_average_linkage():
    """Merging all mutual pairs at once gives the clusters of merging the single best pair each time."""

    def plain(u, at):
        groups = [[i] for i in range(len(u))]
        c = u @ u.T
        while len(groups) > 1:
            best = max((c[np.ix_(a, b)].mean(), -i, -j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
            if best[0] < at:
                break
            i, j = -best[1], -best[2]
            groups[i] += groups.pop(j)
        return sorted(sorted(g) for g in groups)

    for seed in range(6):
        x = blobs([6, 5, 4, 3], seed=seed, spread=0.9, dim=8).astype(np.float64)
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        own = linkage(u, np.ones(len(u)), 0.7)
        got = sorted(sorted(np.flatnonzero(own == c).tolist()) for c in np.unique(own))
        assert got == plain(u, 0.7)


def dense_halves(n):
    """Two groups of different vectors near two centers: all 16 best of a row are in its group, all pairs >= 0.8."""
    rng = np.random.default_rng(4)
    a, b = np.eye(48)[0], 0.9 * np.eye(48)[0] + (1 - 0.81) ** 0.5 * np.eye(48)[1]
    return np.array([c + 0.05 / 48**0.5 * rng.normal(size=48) for c in (a, b) for _ in range(n)], np.float32)


@pytest.mark.parametrize("most", [20_000, 10])
def test_dense_halves_are_one_cluster(spark, most):
    rows = similarity_clusters(frame(spark, dense_halves(20)), dim=48, local_most=most).collect()
    assert {(r["cluster_id"], r["size"], r["outside"]) for r in rows} == {(1, 40, -1.0)} and len(rows) == 40


def test_linkage_of_many_equal_and_dense_rows():
    x = dense_halves(60).astype(np.float64)
    x = np.concatenate([x, x[:1] * np.linspace(1, 9, 700)[:, None], -x[:5]])  # scaled copies all tie
    own = linkage(x / np.linalg.norm(x, axis=1, keepdims=True), np.ones(len(x)), 0.75)
    assert own.tolist() == [0] * 820 + [820] * 5


def test_farthest_first_and_subsets(spark):
    rng = np.random.default_rng(1)
    x = rp.unit(rng.normal(size=(50, 6)))
    none = np.zeros((50, 1), int)
    got = farthest_first(x, none, np.zeros(1, np.float32), 10)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    for i in range(1, 10):
        assert d[got[i], got[:i]].min() == pytest.approx(d[:, got[:i]].min(1).max(), abs=1e-5)
    assert len(set(farthest_first(np.zeros((5, 2), np.float32), np.zeros((5, 1), int), np.zeros(1, np.float32), 9))) == 5
    x = np.concatenate([blobs([300], seed=2), blobs([3, 2], seed=4), np.repeat(blobs([1], seed=6), 150, 0)])
    meta = [{"topic": "big"}] * 300 + [{"topic": " Small "}] * 3 + [{"topic": "small", "source": "rare"}] * 2 + [None] * 75 + [{}] * 75
    rows = [(i, v.tolist(), m, 0) for i, (v, m) in enumerate(zip(x, meta))] + [(None, None, None, 0), (900, None, {"topic": "nov"}, 0), (901, [1.0], None, 0), (5, x[5].tolist(), {"topic": "big"}, 0)]
    df = spark.createDataFrame(rows, "id long, vector array<float>, metadata map<string,string>, place int")
    for kw in ({}, {"part_rows": 50}, {"part_rows": 50, "pool_most": 60}):
        out = [r["id"] for r in varied_subset(df, 20, dim=DIM, **kw).collect()]
        assert len(out) == len(set(out)) == 20
        got_topics = {(dict(meta[i] or {}).get("topic") or "").strip().lower() for i in out if i < len(meta)}
        assert {"big", "small", ""} <= got_topics and 900 in out and any(303 <= i < 305 for i in out)
        assert sum(305 <= i < 455 for i in out) <= 4  # copies are not chosen again
        assert sorted(out) == sorted(r["id"] for r in varied_subset(df.repartition(5), 20, dim=DIM, **kw).collect())
    assert [r["place"] for r in varied_subset(df, 20, dim=DIM).orderBy("place").collect()] == list(range(1, 21))
    many = [r["id"] for r in varied_subset(df, 200, dim=DIM, part_rows=50, pool_most=60).collect()]  # larger than a task may hold
    assert len(many) == len(set(many)) == 200 and sum(305 <= i < 455 for i in many) <= 6


def test_subsets_of_a_cut_pool_cover_as_well(spark):
    """Leaves of the pool fill no shares: the largest distance to the nearest chosen row is near that of one leaf, and small
    groups beside a large one are met as often. A random sample leaves most of them out."""
    x = rp.unit(blobs([600] + [3] * 60, seed=2, spread=0.5))
    df = frame(spark, x).withColumn("metadata", F.create_map(F.lit("a"), F.lit("b")))
    farthest = lambda chosen: float((2 - 2 * (x @ x[chosen].T)).min(1).max())
    met = lambda chosen: len({(i - 600) // 3 for i in chosen if i >= 600})
    one, cut = ([r["id"] - 1 for r in varied_subset(df, 100, dim=DIM, part_rows=100, **kw).collect()] for kw in ({}, {"pool_most": 120}))
    some = [np.random.default_rng(i).choice(len(x), 100, replace=False) for i in range(5)]
    assert farthest(cut) < 1.25 * farthest(one) < 1.25 * min(map(farthest, some))
    assert met(cut) >= 0.9 * met(one) > max(map(met, some))


def test_subset_larger_than_the_table(spark):
    x = blobs([50])
    df = frame(spark, x).withColumn("metadata", F.create_map(F.lit("a"), F.lit("b")))
    assert varied_subset(df.union(df), 10_000, dim=DIM).count() == 50 and varied_subset(df, 0, dim=DIM).isEmpty()


@pytest.mark.parametrize("block", [65_536, 120])
def test_groups_that_outgrow_a_leaf_are_found_whole(spark, monkeypatch, block):
    """Two dense groups of several leaves' rows among others: all neighbours of their rows come out, in order."""
    monkeypatch.setattr(rp, "BLOCK_ROWS", block)
    x = blobs([700, 400] + [3] * 100, seed=9, spread=0.3)
    ids = random.Random(1).sample(range(1, 9000), len(x))
    got, want = lists(nearest(frame(spark, x, ids), 10, 0.8, dim=DIM, leaf_rows=100)), brute(x, ids, 10, 0.8)
    core = rp.fit_cells(rp.unit(x), len(x), 0.8).is_core(rp.unit(x))
    assert core[:1100].mean() > 0.95
    assert all([b for b, _ in got[i]] == [b for b, _ in want[i]] for i, c in zip(ids, core) if c)
    assert sum(len({b for b, _ in got.get(i, [])} & {b for b, _ in v}) for i, v in want.items()) >= 0.97 * sum(map(len, want.values()))


def test_pairs_of_core_rows_meet_in_one_task_of_their_cell():
    x = rp.unit(np.concatenate([blobs([300, 200], seed=9, spread=0.3), np.random.default_rng(2).normal(size=(400, DIM))]))
    ids = np.arange(1000, 1000 + len(x))
    cells = rp.fit_cells(x, len(x), 0.8)
    cells = rp.Cells(cells.centers, np.arccos(cells.core), np.full(len(cells.core), 3), 0.8)
    core, i, task, role = cells.place(x, ids, 3)
    assert 250 < core.sum() < len(x)
    held = {}
    for t in np.unique(task).tolist():
        for members, asks in rp._blocks(role[task == t]):
            rows = i[task == t]
            for a in rows[asks].tolist():
                for b in rows[members].tolist():
                    cell = int(np.searchsorted(cells.first, t, "right"))
                    held[a, b, cell] = held.get((a, b, cell), 0) + 1
    assert set(held.values()) == {1}
    met = {(a, b) for a, b, _ in held}
    near = x.astype(np.float64) @ x.T.astype(np.float64) >= 0.8
    assert all((a, b) in met for a, b in np.argwhere(near & core[:, None]).tolist())


def test_grids_give_own_leaves_first_and_then_the_nearest():
    x = rp.unit(blobs([20] * 20, seed=5, spread=1))
    g = rp.Grids(x, 4000, 2, 200)
    got = g.search(x, 7)
    cos = [x @ c.T for c in g.centers]
    assert (got[:, 0] == cos[0].argmax(1)).all() and (got[:, 1] == 20 + cos[1].argmax(1)).all()
    less = np.concatenate([c.max(1, keepdims=True) - c for c in cos], 1)
    paid = np.take_along_axis(less, got, 1)
    assert (np.diff(paid[:, 2:]) >= 0).all() and np.allclose(paid[:, -1], np.sort(less, 1)[:, 6], atol=1e-6)
    assert (rp.Grids(x[:0], 0, 2, 200).search(x[:3], 4) == [0, 1, -1, -1]).all()


def test_rows_are_sent_once_to_leaves_that_share_a_task(spark):
    """Every leaf still gets all its members and searches, but a row with several leaves in one task is shuffled once for them."""
    x = blobs([20] * 50, seed=5, spread=1)
    u = rp.unit(x)
    g = rp.Grids(u, len(x), 2, 100)
    want = {(i + 1, leaf, 3 if n < 2 else 2) for i, leaves in enumerate(g.search(u, 8).tolist()) for n, leaf in enumerate(leaves)}
    sent = rp.route(frame(spark, x).select("id", "vector"), g, DIM, member=True, query=True, probes=8, coarse=False).select("leaf", "id", "role").collect()
    assert len({(r["leaf"], r["id"]) for r in sent}) == len(sent) < 0.7 * len(want)
    at = {(t, p): leaf for leaf, (t, p) in enumerate(zip(g.task.tolist(), g.place.tolist()))}
    assert len(at) == 20 and max(p for _, p in at) < rp.TOGETHER
    got = set()
    for t in {r["leaf"] for r in sent}:
        ids, role = (np.array([r[c] for r in sent if r["leaf"] == t]) for c in ("id", "role"))
        for p, (own, members, asks) in enumerate(rp._leaves(role)):
            assert (own[members] == 3).all() and (own[asks] > 1).all()
            got |= {(int(ids[a]), at[t, p], int(own[a])) for a in asks}
    assert got == want


def test_a_task_of_leaves_is_bounded_by_its_rows():
    """Leaves of very different size: no task has more rows than eight average leaves, unless it is one leaf."""
    rng = np.random.default_rng(4)
    leaves = np.sort(rng.zipf(1.5, (5000, 4)) % 60, axis=1)
    leaves[:, 1:][leaves[:, 1:] == leaves[:, :-1]] = -1
    held = np.bincount(leaves[leaves >= 0], minlength=60)
    task, place = rp.share(leaves, 60)
    load = np.bincount(task, held)
    assert held.max() > rp.TOGETHER * held.mean() and ((load <= rp.TOGETHER * held.mean()) | (np.bincount(task) == 1)).all()
    assert len(set(zip(task.tolist(), place.tolist()))) == 60 and place.max() < rp.TOGETHER
    assert [a.tolist() for a in rp.share(leaves[:0], 2)] == [[0, 0], [0, 1]]


def test_neighbours_do_not_depend_on_how_leaves_share_tasks(spark, monkeypatch):
    x = blobs([25] * 60 + [1] * 200, seed=3, spread=0.5)
    got = []
    for most in (1, 3, 8):
        monkeypatch.setattr(rp, "TOGETHER", most)
        got.append([lists(nearest(frame(spark, x), 10, 0.6, dim=DIM, leaf_rows=100, **kw)) for kw in ({}, {"queries": F.col("id") % 3 == 0})])
    assert len(got[0][0]) > 1000 and got[0] == got[1] == got[2]


def test_subsets_do_not_depend_on_the_size_of_a_block(spark):
    """One definition at every size: a pool in one block, in three and in many gives the same order."""
    x = rp.unit(blobs([600] + [3] * 60, seed=2, spread=0.5))
    topic = F.when(F.col("id") % 7 == 0, "odd").otherwise("even")
    df = frame(spark, x).withColumn("metadata", F.create_map(F.lit("topic"), topic))
    orders = [[r["id"] for r in varied_subset(df, 100, dim=DIM, part_rows=100, pool_most=most).orderBy("place").collect()] for most in (20_000, 120, 25)]
    assert len(orders[0]) == 100 and orders[0] == orders[1] == orders[2]
    kept = x[[i - 1 for i in orders[0]]]
    apart = 2 - 2 * kept @ kept.T + 0.6 * np.array([[(a % 7 == 0) != (b % 7 == 0) for a in orders[0]] for b in orders[0]])
    least = [apart[i, :i].min() for i in range(1, 100)]
    assert np.allclose(least, np.sort(least)[::-1], atol=1e-5)  # one shared radius, and places by distance from earlier ones


def test_distances_from_earlier_rows_of_the_other_side():
    rng = np.random.default_rng(3)
    x, labels, w = rp.unit(rng.normal(size=(70, 6))), rng.integers(0, 3, (70, 2)), np.array([0.6, 0.3], np.float32)
    d = ((x[:, None].astype(float) - x[None]) ** 2).sum(2) + ((labels[:, None] != labels[None]) * w).sum(2)
    side = rng.random(70) < 0.4
    for s, among in ((None, None), (side, None), (np.ones(70, bool), None), (None, rng.random(70) < 0.5), (side, rng.random(70) < 0.5)):
        got = from_earlier(x, labels, w, s, among)
        for i in range(70):
            before = [d[i, j] for j in range(i) if (s is None or s[j] != s[i]) and (among is None or among[j])]
            assert got[i] == pytest.approx(min(before, default=64), abs=2e-6)
