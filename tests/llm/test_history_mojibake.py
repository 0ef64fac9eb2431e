from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.llm import history as hs
from vectide.llm import mojibake as mj
from vectide.llm.history import History, dedup_batches, in_order

DIM = 8


def vec(rng):
    return [float(x) for x in rng.normal(size=DIM).astype(np.float32)]


def fine(v):
    if v is None or len(v) != DIM:
        return None
    v = np.asarray(np.asarray(v, np.float32), float)
    return v / np.linalg.norm(v) if np.isfinite(v).all() and v.any() else None


def in_sequence(records, incoming):
    """Plain definition: one row after another against all accepted before it."""
    accepted = [(i, set(hs.words(t)), fine(v)) for i, v, t in records]
    out = {}
    for recv, batch, id, v, t in sorted(incoming, key=lambda r: (r[1], r[0])):
        w, u = set(hs.words(t)), fine(v)
        hits = [i for i, x, y in accepted if i == id or (w and x and len(w & x) >= 0.8 * len(w | x) - 1e-9) or (u is not None and y is not None and round(float(u @ y), 6) >= 0.985)]
        out[recv] = min(hits) if hits else None
        if not hits and id is not None:
            accepted.append((id, w, u))
    return out


def world(seed=0, n=120, m=160):
    rng, r = np.random.default_rng(seed), random.Random(seed)
    lexicon = [f"w{i}x{'y' * (i % 9)}" for i in range(60)]
    text = lambda: " ".join(r.choice(lexicon) for _ in range(r.randrange(3, 14))) + f" u{r.randrange(10**6)}"
    records = [(i * 3 + 1, vec(rng), text()) for i in range(n)]
    seen = [(i, v, t) for i, v, t in records]
    incoming = []
    for k in range(m):
        id, v, t = 5000 + k, vec(rng), text()
        i0, v0, t0 = r.choice(seen)
        kind = r.randrange(9)
        if kind == 0:
            id = i0
        elif kind == 1:
            v = [2 * x for x in v0] if v0 else v0
        elif kind == 2:
            v = [x * (1 + 0.02 * rng.normal()) for x in v0] if v0 and len(v0) == DIM else v0
        elif kind == 3:
            t = (t0 or "").upper() + " !"
        elif kind == 4:
            t = " ".join((t0 or "").split()[:-1] + ["other"])
        elif kind == 5:
            id, v, t = None, r.choice([None, [], [0.0] * DIM, [1.0], [float("nan")] * DIM]), r.choice([None, "", " - ", t0])
        elif kind == 6:
            id, v, t = i0, v0, t0
        row = (10**6 + k, r.randrange(1, 5), id, v, t)
        incoming.append(row)
        if id is not None:
            seen.append((id, v, t))
    return records, incoming


R = "id long, vector array<float>, text string"
I = "recv_id long, batch_no int, id long, vector array<float>, text string"


def tables(spark, records, incoming):
    return spark.createDataFrame(records, R), spark.createDataFrame(incoming, I).withColumn("pos", F.lit("clash")).withColumn("key", F.lit(0))


def dedup(records, incoming):
    return dedup_batches(History.start(records, dim=DIM), incoming)


@pytest.mark.parametrize("seed", [0, 1])
def test_decisions_in_order(spark, seed):
    records, incoming = world(seed)
    want = in_sequence(records, incoming)
    got = {r["key"]: r["match"] for r in dedup(*tables(spark, records, incoming)).collect()}
    assert got == want


def test_batches_one_by_one(spark):
    records, incoming = world(3, n=60, m=60)
    rec, inc = tables(spark, records, [*incoming, (10**6 - 1, None, 4999, incoming[0][3], "a text of no batch")])
    got = {r["key"]: r["match"] for r in dedup_batches(History.start(rec, dim=DIM), inc, step_rows=0).collect()}
    assert got == in_sequence(records, [*incoming, (10**6 - 1, 0, 4999, incoming[0][3], "a text of no batch")])


def test_a_history_is_reopened_and_merges_its_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hs, "MERGE", 2)
    monkeypatch.setattr(hs, "MOST_BLOCKS", 0)  # searches meet the leaves in a shuffle
    records, incoming = world(4, n=60, m=60)
    rec, inc = tables(spark, records, incoming)
    source, path = str(tmp_path / "records"), str(tmp_path / "history")
    rec.repartitionByRange(6, "id").write.parquet(source)
    History.start(spark.read.parquet(source), path=path, source=source, dim=DIM)
    got = {}
    for b in range(1, 5):
        h = History.open(spark, path)
        d = h.decide(in_order(inc.where(F.col("batch_no") == b)))
        got |= {r["key"]: r["match"] for r in d.decided.collect()}
        h.append(d)
    assert got == in_sequence(records, incoming)
    h = History.open(spark, path)
    assert h.about["batches"] == 4 and all(len(level) < 2 for levels in h.about["parts"].values() for level in levels)
    assert h.rows.count() == len(records) + sum(m is None and i[2] is not None for i in incoming for m in [got[i[0]]])
    listed = {p for levels in h.about["parts"].values() for level in levels for p in level}
    assert listed <= {p.name for p in (tmp_path / "history").iterdir()}
    # only files that may hold a candidate are read
    some = h._fetch(spark.createDataFrame([(records[0][0],), (records[-1][0],)], "key long"), "text")
    assert sorted(r["key"] for r in some.collect()) == [records[0][0], records[-1][0]]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert f"LessThanOrEqual(id,{records[0][0]})" in plan


def test_ranges_hold_all_values():
    v = np.random.default_rng(0).integers(-(2**62), 2**62, 500)
    assert str(hs.in_ranges("k", v, 8)).count(">=") == 8
    assert str(hs.in_ranges("k", np.array([5, 5]), 8)).count(">=") == 1


def test_common_chunks():
    a, b = hs.Common(np.array([9, 3, 5]), np.array([1, 2, 3])), hs.Common(np.array([5, 4]), np.array([7, 8]))
    assert (a | b).of_chunks(np.array([3, 4, 5, 9, 10, -1])).tolist() == [2, 8, 7, 1, 0, 0]
    assert hs.Common(np.zeros(0, np.int64), np.zeros(0, np.int64)).of_chunks(np.array([1])).tolist() == [0]


def test_a_third_of_a_batch_is_one_row_sent_again(spark):
    rng = np.random.default_rng(5)
    records = [(i, vec(rng), f"alpha beta gamma {i} delta") for i in range(1, 40)]
    v = vec(rng)
    incoming = [(1000 + i, 1 + i % 3, 700, v, "one two three four") for i in range(200)] + [(2000 + i, 1, 800 + i, vec(rng), f"p{i} q{i} r{i}") for i in range(30)]
    rec, inc = tables(spark, records, incoming + incoming[:1])  # and one recv_id twice
    got = {r["key"]: r["match"] for r in dedup(rec, inc).collect()}
    assert got == in_sequence(records, incoming)
    assert sum(x == 700 for x in got.values()) == 199
    none = dedup(rec.limit(0), inc.limit(0))
    assert none.isEmpty()
    assert {r["match"] for r in dedup(rec.limit(0), inc.limit(5)).collect()} <= {None, 700}


def test_chunks_lose_no_pair():
    """Two word sets of enough overlap always share a chunk among each other's rarest, and enough bytes."""
    r = random.Random(2)
    for _ in range(3000):
        n = r.randrange(1, 30)
        a = {f"{r.choice('abc')}{r.randrange(400)}{'z' * r.randrange(12)}" for _ in range(n)}
        b = set(a)
        for _ in range(r.randrange(4)):
            b = b - {r.choice(sorted(b))} if r.random() < 0.5 and len(b) > 1 else b | {f"n{r.randrange(999)}"}
        if len(a & b) < 0.8 * len(a | b):
            continue
        side = []
        for w in (sorted(a), sorted(b)):
            c: dict = {}
            for x in w:
                c.update(hs.chunks(x))
            need = hs.least_shared([len(x) + 1 for x in w], sum(c.values()))
            left, rare = sum(c.values()), set()
            for h in sorted(c):
                if left < need:
                    break
                rare.add(h)
                left -= c[h]
            side.append((c, need, rare, hs.word_bits(w), len(w)))
        (c1, n1, p1, b1, m1), (c2, n2, p2, b2, m2) = side
        assert p1 & p2
        assert sum(c1[h] for h in c1.keys() & c2.keys()) >= max(n1, n2)
        assert bin((b1 ^ b2) & (2**64 - 1)).count("1") <= (m1 + m2) / 9 + 1e-9


def test_words():
    assert hs.words("Ｆｏｏ foo_BAR x² é-1") == ["1", "bar", "foo", "x2", "é"]
    assert hs.words(None) == hs.words(" - ") == []


# ---------------------------------------------------------------------------------------------------------------------
CLEAN = [
    "Le problème a déjà été signalé hier matin.", "La configuración también guardó las métricas más antiguas.", "Größere Dateien überschreibt der Änderungsdienst später.",
    "A função não aceita as exceções depois da atualização.", "Someone called it “a known quirk”, and the cursor does the same… again.", "Le réseau élargi préfère une clé générale.",
]
MIXUPS = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp1251"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("cp1252", "cp1251"), ("cp1252", "cp437"), ("cp1252", "utf-8")]


def corpus():
    rows, want, n = [], {}, 0
    for i, text in enumerate(CLEAN):
        for k in range(40):
            rows.append((n := n + 1, text + f"\nLine {k} of text {i}."))
        for w, r in MIXUPS:
            bad = mj.garble(text, w, r)
            if bad is not None and bad != text:
                for k in range(2):
                    rows.append((n := n + 1, bad + f"\nMore {k}."))
                    want[n] = text + f"\nMore {k}."
    twice = mj.garble(mj.garble(CLEAN[0], "utf-8", "cp1252"), "utf-8", "cp1252")
    rows.append((n := n + 1, twice))
    want[n] = CLEAN[0]
    good = ["Спасибо, всё работает! «Сёма» сказал: ДОКТОР».", "Το αρχείο δεν βρέθηκε", "缓存已经清空，但结果不变。", "├── a\n│   └── b", "café au lait, l’été déjà", "½ cup, 5 µm, ±3 °C, ÄÖÜ É», ÇÃ «AMANHû", "🙂🙂 💡", "서버가 응답하지 않습니다", "", "   ", None, "plain ascii"]
    for t in good:
        rows.append((n := n + 1, t))
    rows.append((None, "Ã©tÃ©"))
    return rows, want


@pytest.fixture(scope="module")
def found(spark):
    rows, want = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("words", F.lit("clash")).withColumn("layers", F.lit(-1))
    return {r["doc_id"]: r for r in mj.find_garbled(df, restore=True).collect()}, want


def test_garbled_documents_are_found(found):
    got, want = found
    assert set(got) == set(want) | {None}
    assert got[None]["restored"] == "été"


def test_originals_are_regained(found):
    got, want = found
    assert sum(got[k]["restored"] == t for k, t in want.items()) / len(want) >= 0.95
    assert max(r["layers"] for r in got.values()) == 2


def test_transformations_explain_pairs():
    assert ("utf-8", "cp1252") in mj.explains("Ã©", "é")
    assert mj.explains("x", "é") == []
    assert list(mj._aligned("dÃ©jÃ\xa0 vu", "déjà vu")) == [("Ã©", "é"), ("Ã\xa0", "à")]
    assert list(mj._aligned("café", "café")) == []


def test_empty_and_small_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert mj.find_garbled(df).isEmpty()
    pair = [("PrÃ¼fung der EintrÃ¤ge %d", "Prüfung der Einträge %d")]
    few = spark.createDataFrame([(2 * i + j, t % i) for i in range(4) for p in pair for j, t in enumerate(p)], "doc_id long, text string")
    assert [r["doc_id"] for r in mj.find_garbled(few).orderBy("doc_id").collect()] == [0, 2, 4, 6]
    # two texts without twins teach nothing
    one = spark.createDataFrame([(1, "PrÃ¼fung der EintrÃ¤ge"), (2, "Prüfung")], "doc_id long, text string")
    assert mj.find_garbled(one).isEmpty()
