from __future__ import annotations

import contextlib
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.errors import DimensionMismatch, InvalidVector
from vectide.functions import vecmath as vm
from vectide.operators import graph as nsw
from vectide.operators.search import batch_knn, exact_topk, recall_at_k, resolve
from vectide.schema import RECORD, GraphParams


def table(spark, rows):
    return spark.createDataFrame([(i, list(map(float, v)), t, m) for i, v, t, m in rows], RECORD)


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def demo(spark):
    return table(spark, [(1, [0.9, 0.1, 0], "a", {"topic": "animals"}), (2, [0.8, 0.2, 0.1], "b", {"topic": "animals"}), (3, [0.1, 0.1, 0.9], "c", {"topic": "rust", "x": "1"})])


def test_order_and_scores(demo):
    hits = exact_topk(demo, [0.85, 0.15, 0.05], 3).collect()
    assert [r["id"] for r in hits] == [1, 2, 3]
    assert [round(r["score"], 4) for r in hits] == [0.9963, 0.9956, 0.1841]


def test_filters(demo):
    q = [0.85, 0.15, 0.05]
    assert [r["id"] for r in exact_topk(demo, q, 5, {"topic": "rust"}).collect()] == [3]
    assert [r["id"] for r in exact_topk(demo, q, 5, {"topic": "rust", "x": "1"}).collect()] == [3]
    assert exact_topk(demo, q, 5, {"topic": "rust", "y": "1"}).isEmpty()
    assert exact_topk(demo, q, 5, {"topic": "Rust"}).isEmpty()
    assert exact_topk(demo, q, 99).count() == 3 and exact_topk(demo, q, 0).count() == 0


def test_query_is_checked_even_for_no_results(demo):
    for bad in ([], [float("nan"), 1, 2], [float("inf"), 0, 0]):
        with pytest.raises(InvalidVector):
            exact_topk(demo, bad, 0)
    with pytest.raises(DimensionMismatch, match="expected 3, got 2"):
        exact_topk(demo, [1, 2], 0, dimension=3)


def test_ties_go_to_the_smaller_id(spark):
    df = table(spark, [(i, [1, 0], "", {}) for i in (9, 4, 7, 1)])
    assert [r["id"] for r in exact_topk(df, [1, 0], 3).collect()] == [1, 4, 7]


def test_plans_are_bounded_heaps(spark, demo):
    assert "TakeOrderedAndProject" in plan(exact_topk(demo, [1, 0, 0], 2))
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "query_id long, query_vector array<float>")
    assert "WindowGroupLimit" in plan(batch_knn(demo, q, 2))


def test_forty_by_twelve(spark, vec):
    df = table(spark, [(i, vec(i, 12), "", {}) for i in range(40)])
    got = exact_topk(df, vec(999, 12), 5).collect()
    assert [(r["id"], round(r["score"], 6)) for r in got] == [(34, 0.742226), (30, 0.544875), (31, 0.448476), (39, 0.421868), (11, 0.343294)]


def test_batch_equals_single_and_handles_dirt(spark, vec):
    df = table(spark, [(i, vec(i, 12), "", {"p": str(i % 2)}) for i in range(80)] + [(500, vec(3, 12), "", {"p": "1"})])
    rows = [(j, vec(1000 + j, 12)) for j in range(7)] + [(90, None), (91, []), (92, [1.0]), (None, vec(1, 12)), (93, vec(3, 12))]
    q = spark.createDataFrame(rows, "query_id long, query_vector array<float>")
    for groups in (1 << 20, 150):
        got: dict = {}
        for r in batch_knn(df, q, 4, {"p": "1"}, block=2, most_bytes=groups).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["id"], np.float32(r["score"])))
        assert sorted(got) == [0, 1, 2, 3, 4, 5, 6, 93]
        for j, v in rows:
            if j in got:
                assert got[j] == [(r["id"], np.float32(r["score"])) for r in exact_topk(df, v, 4, {"p": "1"}).collect()]
    assert batch_knn(df, q, 0).isEmpty() and batch_knn(df.limit(0), q, 3).isEmpty() and batch_knn(df, q.limit(0), 3).isEmpty()


def test_graph_agrees_with_exact_top_one(spark, vec):
    df = table(spark, [(i, vec(i, 16), "", {}) for i in range(60)])
    queries = [(j, vec(1000 + j, 16)) for j in range(10)]
    want = [3, 51, 23, 19, 29, 45, 26, 33, 23, 55]
    for m in (8, 16):
        p = GraphParams(m, 64, 60)
        for shards in (1, 3):
            g = nsw.build(df, p, shards=shards).cache()
            hits = nsw.walk(g, queries, 1, p).orderBy("query_id").collect()
            assert [r["id"] for r in hits] == want
            nsw.check_graph(nsw.structure(g), df)
    assert [exact_topk(df, q, 1).first()["id"] for _, q in queries] == want


def test_graph_ties_reachability_and_recall(spark, vec):
    same = table(spark, [(i, [1, 0], "", {}) for i in range(6)])
    p = GraphParams()
    g = nsw.build(same, p)
    assert [r["id"] for r in nsw.walk(g, [(0, [1.0, 0.0])], 3, p).orderBy("rank").collect()] == [0, 1, 2]
    assert [r["id"] for r in nsw.walk(g, [(0, [1.0, 0.0])], 3, p, tie_break="node").orderBy("rank").collect()] == [5, 4, 3]
    df = table(spark, [(i, vec(i, 16), "", {}) for i in range(60)])
    thin = nsw.reachable(nsw.build(df, GraphParams(2, 4, 4))).first()
    assert thin["nodes"] == 60 and thin["reachable"] < 60
    q = spark.createDataFrame([(j, vec(1000 + j, 16)) for j in range(10)], "query_id long, query_vector array<float>")
    truth = batch_knn(df, q, 5)
    got = nsw.walk(nsw.build(df, p), [(j, vec(1000 + j, 16)) for j in range(10)], 5, p)
    assert recall_at_k(truth, got).agg(F.avg("recall")).first()[0] >= 0.95


def test_walk_scores_are_exact(spark, vec):
    df = table(spark, [(i, vec(i, 16), "", {}) for i in range(30)])
    p = GraphParams(ef_search=30)
    hits = nsw.walk(nsw.build(df, p), [(0, vec(77, 16))], 5, p)
    exact = {r["id"]: r["score"] for r in exact_topk(df, vec(77, 16), 30).collect()}
    assert all(r["score"] == exact[r["id"]] for r in hits.collect())
    assert vm.norm_of([3, 4]) == 5


def test_standalone_index(spark, vec):
    i = nsw.AnnIndex(spark, GraphParams(8, 32, 60))
    assert i.is_empty() and i.search([1.0], 3).isEmpty()
    i.insert([(j, vec(j, 16)) for j in range(40)])
    i.insert(table(spark, [(j, vec(j, 16), "", {}) for j in range(40, 60)]))
    assert i.count() == 60 and i.dimension == 16
    assert [i.search(vec(1000 + j, 16), 1).first()["id"] for j in range(3)] == [3, 51, 23]
    assert i.search_with_ef(vec(1000, 16), 5, 1).count() == 5 and i.search(vec(1, 16), 0).isEmpty()
    with pytest.raises(DimensionMismatch):
        i.insert([(99, [1.0])])
    with pytest.raises(InvalidVector):
        i.search([], 0)
    with pytest.raises(InvalidVector, match="greater than zero"):
        nsw.AnnIndex(spark, dimension=0)
    back = nsw.AnnIndex.restore(i.rows, i.persisted(), i.params)
    want = [(r["id"], r["score"]) for r in i.search(vec(7, 16), 5).orderBy("rank").collect()]
    assert [(r["id"], r["score"]) for r in back.search(vec(7, 16), 5).orderBy("rank").collect()] == want


def test_inserts_extend_the_graph(spark, vec, monkeypatch):
    """New records are inserted into the shards they belong to: the same graph as one built in id order; beyond twice a
    shard's rows all is built anew."""
    rows = [(i, vec(i, 16), "", {}) for i in range(60)]
    p = GraphParams(8, 32, 60)
    whole, first, second = (table(spark, r) for r in (rows, rows[:35], rows[35:]))
    links = lambda g: sorted(map(tuple, nsw.structure(g).collect()))
    for shards in (1, 3):
        assert links(nsw.extend(nsw.build(first, p, shards=shards), second, p, shards)) == links(nsw.build(whole, p, shards=shards))
    calls = []
    build = nsw.build
    monkeypatch.setattr(nsw, "build", lambda *a, **kw: calls.append(1) or build(*a, **kw))
    i = nsw.AnnIndex(spark, p)
    i.insert(first)
    i.search(vec(1000, 16), 1).collect()
    i.insert(second)
    assert i.search(vec(1000, 16), 1).first()["id"] == 3 and len(calls) == 1
    monkeypatch.setattr(nsw, "SHARD_ROWS", 20)
    i.insert([(60, vec(60, 16))])
    assert i.search(vec(60, 16), 1).first()["id"] == 60 and len(calls) == 2
    empty = nsw.build(first.limit(0), p)
    assert links(nsw.extend(empty, second, p, 1)) == links(build(second, p))


def test_a_search_of_the_graph_does_not_shuffle_it(spark, vec, tmp_path):
    rows = table(spark, [(i, vec(i, 16), "", {}) for i in range(60)])
    nsw.build(rows, GraphParams(), shards=3).write.parquet(f"{tmp_path}/g")
    plan = nsw.walk(spark.read.parquet(f"{tmp_path}/g"), [(0, vec(1, 16))], 3, GraphParams())._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.index("MapInArrow")  # only hits are shuffled: the plan is printed from its end
    assert plan.count("Exchange hashpartitioning") == 1


def test_payloads_are_read_by_pushed_ids(spark, vec, tmp_path):
    records = table(spark, [(i, vec(i, 8), f"text {i}", {"k": "v"}) for i in range(50)])
    records.write.parquet(f"{tmp_path}/r")
    stored = spark.read.parquet(f"{tmp_path}/r")
    hits = exact_topk(records, vec(3, 8), 3).select("id", "score")
    got = resolve(hits, stored)
    assert "PushedFilters: [In(id, [" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["id"], r["text"]) for r in got.collect()) == sorted((r["id"], f"text {r['id']}") for r in hits.collect())
    assert resolve(hits.limit(0), stored).isEmpty()
    many = resolve(spark.range(1500).select("id", F.lit(1.0).alias("score")), stored)
    assert many.count() == 50 and "In(id" not in many._jdf.queryExecution().executedPlan().toString()
