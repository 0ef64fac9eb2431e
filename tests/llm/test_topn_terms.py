from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from vectide.llm.termfreq import _scan, term_counts, term_frequencies
from vectide.llm.topn import first_of_repeats, top_n_per_group


def rows(n=3000, seed=2):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        g = rng.choice(["hot", "hot", "hot", *[f"g{rng.randrange(400)}"] * 4, None])
        s = rng.choice([0.0, -0.0, 1.5, 2.5, None, math.nan, rng.random()])
        out.append((g, s, rng.randrange(50), i, {"k": "v"}))
    return out


SCHEMA = "s string, score float, t int, h long, g map<string,string>"  # columns named like internal ones


@pytest.mark.parametrize("heavy, salt", [(20_000, 10_000), (50, 20), (1, 1)])
def test_top_n_against_sorting(spark, heavy, salt):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    got = top_n_per_group(df, F.col("s"), F.col("score"), [F.col("t"), F.col("h")], 7, heavy_rows=heavy, salt_rows=salt, rank="place")
    assert got.columns == ["s", "score", "t", "h", "g", "place"]
    want = defaultdict(list)
    for g, s, t, h, _ in data:
        if s is not None and not math.isnan(s):
            want[g].append((-s + 0.0, t, h))
    assert sorted((str(r["s"]), r["place"], r["h"]) for r in got.collect()) == sorted((str(g), i + 1, x[2]) for g, v in want.items() for i, x in enumerate(sorted(v)[:7]))


def test_top_n_cases(spark):
    df = spark.createDataFrame([("a", 1.0, 1, 1, None)] * 5 + [("a", 2.0, None, 2, {}), ("a", 2.0, 1, 3, {})], SCHEMA)
    top = top_n_per_group(df, F.col("s"), F.col("score"), [F.col("t")], 3).collect()
    assert [r["h"] for r in sorted(top, key=lambda r: (-r["score"], r["t"] or 0))] == [2, 3, 1]  # null ties first, repeats count
    assert top_n_per_group(df, F.col("s"), F.col("score"), [], 0).isEmpty()
    assert top_n_per_group(df.limit(0), F.col("s"), F.col("score"), [], 3).isEmpty()
    first = top_n_per_group(df.repartition(3), F.col("s"), F.col("score"), [], 2).collect()
    assert sorted(map(str, first)) == sorted(map(str, top_n_per_group(df, F.col("s"), F.col("score"), [], 2).collect()))


def test_first_of_repeats(spark):
    df = spark.createDataFrame([(1, 1, 9, "c"), (1, 1, 3, "a"), (None, 1, 5, "x"), (None, 1, 4, "y")], "q int, id int, r int, v string")
    assert sorted((r["r"], r["v"]) for r in first_of_repeats(df, ["q", "id"], "r").collect()) == [(3, "a"), (4, "y")]


META = [
    (1, {"tags": " A ; b,b|A;; ", "lang": " EN "}), (2, {"tags": "b", "lang": "en", "source": ""}), (3, {}), (4, None), (5, {"lang": " en\t", "tags": None}),
    (5, {"lang": "en", "tags": None}), (None, {"lang": "x"}), (None, {"lang": "x"}), (0, {"lang": "x"}), (-1, {"lang": "x"}), (6, {"lang": "de, fr"}),
]


def test_terms_of_dirty_maps(spark):
    df = spark.createDataFrame([(i, m, "clash") for i, m in META], "id long, metadata map<string,string>, term string")
    got = {(r["meta_key"], r["term"]): (r["occurrences"], r["records"]) for r in term_counts(df).collect()}
    assert got == {("tags", "a"): (2, 1), ("tags", "b"): (3, 2), ("lang", "en"): (4, 3), ("lang", "x"): (4, 3), ("lang", "de, fr"): (1, 1)}
    marks = {(r["meta_key"], r["term"]): r["mark"] for r in term_frequencies(df, rare_below=2, common_above=0.25).collect()}
    assert marks[("lang", "en")] == "common" and marks[("tags", "b")] == "kept" and marks[("lang", "de, fr")] == "rare"
    assert term_frequencies(df.limit(0)).isEmpty()


def test_terms_against_counting(spark):
    rng = random.Random(3)
    data = [(i // 2, {"tags": ";".join(rng.choice(["hot", f"t{rng.randrange(300)}"]) for _ in range(rng.randrange(5)))}) for i in range(4000)]
    occ, rec = Counter(), defaultdict(set)
    for i, m in data:
        for t in m["tags"].split(";"):
            if t:
                occ[t] += 1
                rec[t].add(i)
    df = spark.createDataFrame(data, "id long, metadata map<string,string>").repartition(6)
    got = {r["term"]: (r["occurrences"], r["records"]) for r in term_counts(df).collect()}
    assert got == {t: (n, len(rec[t])) for t, n in occ.items()}


def test_runs_over_batches():
    """A run that goes on through several batches, and an id that goes on through two."""
    import pyarrow as pa

    data = [("k", "a", 1, 2), ("k", "a", 1, 1), ("k", "a", 2, 1), ("k", "a", 2, 3), ("k", "a", 3, 1), ("k", "b", 3, 1), ("l", "b", 3, 1)]
    for size in (1, 2, 3, 7):
        batches = []
        for at in range(0, len(data), size):
            c = list(zip(*data[at : at + size]))
            batches.append(pa.RecordBatch.from_arrays([pa.array(c[0]), pa.array(c[1]), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int32()), pa.array([False] * len(c[0]))], names=["meta_key", "term", "id", "n", "nameless"]))
        got = [tuple(r.values()) for b in _scan(iter(batches)) for r in b.to_pylist()]
        assert got == [("k", "a", 8, 3), ("k", "b", 1, 1), ("l", "b", 1, 1)]
    assert list(_scan(iter([]))) == []
