from __future__ import annotations

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vectide.llm.bpe import BytePairEncoder, count_tokens, encode_texts, tokenizer_path
from vectide.llm import packing
from vectide.llm.packing import nnls, pack_items, plan_containers

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def ours():
    return BytePairEncoder(tokenizer_path())


@pytest.fixture(scope="module")
def theirs():
    t = tokenizers.Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_ids_equal_the_public_library(ours, theirs, text):
    assert ours.encode(text) == theirs.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abc xé\n0<|endoftext|>漢😀", max_size=400))
def test_ids_of_repetitive_text(ours, theirs, text):
    assert ours.encode(text) == theirs.encode(text, add_special_tokens=False).ids


def test_merge_equals_repeated_scans(ours):
    """The segment tree against the plain definition: merge the leftmost pair of least rank until there is none."""

    def plain(piece: bytes):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            ranked = [(ours.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ours.ranks]
            if not ranked:
                return tuple(ours.ranks[p] for p in parts)
            i = min(ranked)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(4)
    for _ in range(300):
        piece = bytes(rng.choice(b"abcdeinrst") for _ in range(rng.randrange(1, 60)))
        assert ours.merge(piece) == plain(piece)


def test_a_very_long_piece(ours):
    back = {i: b for b, i in ours.ranks.items()}
    text = "ab" * 100_000 + "x" * 100_000
    assert b"".join(map(back.__getitem__, ours.encode(text))).decode() == text


def test_tables(spark, theirs):
    rows = [(1, "Hello world", 0), (1, "Hello world", 1), (2, None, 0), (3, "", 0), (None, " \n\t ", 0), (4, "<|endoftext|>", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")  # a clashing column
    got = sorted(((r["doc_id"], list(r["ids"])) for r in encode_texts(df).collect()), key=str)
    want = sorted(((k, theirs.encode(t, add_special_tokens=False).ids if t else []) for k, t, _ in rows), key=str)
    assert got == want
    assert sorted((r["n_tokens"] for r in count_tokens(df).collect())) == sorted(len(i) for _, i in want)
    assert encode_texts(df.limit(0)).isEmpty()


def check_packing(rows, items, capacity):
    """Every piece placed once, no container over capacity, pieces full but the last."""
    load, pieces = Counter(), {}
    for r in rows:
        load[r["container_id"]] += r["piece_size"]
        pieces.setdefault(r["doc_id"], []).append((r["piece_no"], r["piece_start"], r["piece_size"]))
    assert all(0 <= v <= capacity for v in load.values())
    assert sorted(pieces) == sorted(items)
    for k, n in items.items():
        p = sorted(pieces[k])
        assert [x[0] for x in p] == list(range(len(p)))
        assert sum(x[2] for x in p) == n and all(x[2] == capacity for x in p[:-1])
        assert [x[1] for x in p] == [i * capacity for i in range(len(p))]
    return load


def test_packing_is_tight_and_complete(spark):
    rng = random.Random(1)
    items = {i: min(3000, int(rng.expovariate(1 / 150)) + 1) for i in range(3000)} | {90001: 5000, 90002: 2048, 90003: 4096, 90004: 0, 90005: 0}
    df = spark.createDataFrame(list(items.items()), "doc_id long, n_tokens long")
    load = check_packing(pack_items(df).collect(), items, 2048)
    assert max(load) + 1 == len(load)
    assert len(load) <= -(-sum(items.values()) // 2048) + 1
    again = {(r["doc_id"], r["piece_no"]): r["container_id"] for r in pack_items(df.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["piece_no"]): r["container_id"] for r in pack_items(df).collect()}


def test_one_size_holds_a_third(spark):
    items = {i: 700 for i in range(400)} | {1000 + i: 1 + i % 1400 for i in range(800)}
    df = spark.createDataFrame(list(items.items()), "doc_id long, n_tokens long")
    load = check_packing(pack_items(df).collect(), items, 2048)
    assert sum(load.values()) / len(load) / 2048 > 0.97


def test_odd_items(spark):
    df = spark.createDataFrame([(1, None), (2, 0), (None, 5), (3, 7)], "doc_id long, n_tokens long")
    rows = pack_items(df, 10).collect()
    assert len(rows) == 4 and sum(r["piece_size"] for r in rows) == 12
    only_empty = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, n_tokens long")
    assert {r["container_id"] for r in pack_items(only_empty, 10).collect()} == {0}
    assert pack_items(df.limit(0), 10).isEmpty()
    twice = spark.createDataFrame([(1, 6), (1, 6)], "doc_id long, n_tokens long")
    assert {r["container_id"] for r in pack_items(twice, 10).collect()} == {0, 1}


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 200), max_size=12))
def test_plan_places_each_item_once(histogram):
    rows, containers = plan_containers(histogram, 30)
    load = Counter()
    for s, n in histogram.items():
        ranks = sorted((a, b) for size, a, b, _, _ in rows if size == s)
        assert ranks[0][0] == 0 and ranks[-1][1] == n and all(x[1] == y[0] for x, y in zip(ranks, ranks[1:]))
    for s, a, b, base, per in rows:
        for i in range(b - a):
            load[base + i // per] += s
    assert all(v <= 30 for v in load.values()) and (not load or max(load) < containers)


def test_least_squares():
    import numpy as np

    rng = np.random.default_rng(0)
    index = np.array([rng.choice(40, 4, replace=False) for _ in range(15)])
    value = rng.random((15, 4))
    a = np.zeros((40, 15))
    for j in range(15):
        a[index[j], j] = value[j]
    x = np.maximum(0, rng.normal(size=15))
    assert np.allclose(nnls(index, value, a @ x, 5000), x, atol=1e-2)
    assert nnls(np.zeros((0, 4), int), np.zeros((0, 4)), np.ones(3)).size == 0


def test_a_size_is_ranked_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 10)
    items = spark.createDataFrame([(i, 7 if i % 3 else 0) for i in range(200)], "doc_id long, n_tokens int")
    rows = pack_items(items, 28).collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) == 200
    full = Counter(r["container_id"] for r in rows if r["piece_size"])
    assert max(full.values()) <= 4 and len(full) == -(-sum(i % 3 > 0 for i in range(200)) // 4)
