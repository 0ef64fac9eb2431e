from __future__ import annotations

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vectide import cli
from vectide.collection import Collection, LazyCollection
from vectide.errors import Corrupt, DimensionMismatch, DuplicateId, InvalidId, InvalidVector, NotFound, SerializationError, StorageError, UnsupportedVersion
from vectide.functions.validate import check_rows
from vectide.operators import graph as nsw
from vectide.operators import mutate
from vectide.schema import RECORD, SCALAR8, GraphParams, graph_index
from vectide.sources import store
from vectide.streaming.ingest import upsert_stream


def rec(id, vector, text="", **metadata):
    return {"id": id, "vector": vector, "text": text, "metadata": metadata}


def test_crud_errors_in_order(spark):
    c = Collection.create(spark)
    c.insert([rec(1, [1.0, 0.0])])
    with pytest.raises(DuplicateId, match="a record with id 1 already exists"):
        c.insert([rec(1, [float("nan")])])  # a duplicate is reported before a bad vector
    c.upsert([rec(1, [0.0, 1.0], "new")])
    assert c.get(1)["vector"] == [0.0, 1.0] and c.get(1)["text"] == "new" and c.get(1)["metadata"] == {}
    assert [r["id"] for r in c.delete(1).collect()] == [1]
    with pytest.raises(NotFound, match="no record with id 1"):
        c.delete(1)
    assert c.is_empty() and c.dimension == 2 and c.get(1) is None
    with pytest.raises(DimensionMismatch):
        c.insert([rec(5, [1.0])])  # the dimension stays after all records are gone


@pytest.mark.parametrize("bad, error", [([], InvalidVector), ([float("nan"), 1.0], InvalidVector), ([float("inf"), 1.0], InvalidVector), ([float("-inf"), 1.0], InvalidVector), ([1.0, 2.0, 3.0], DimensionMismatch)])
def test_bad_vectors_change_nothing(spark, bad, error):
    c = Collection.create(spark, 2)
    for call in (c.insert, c.upsert):
        with pytest.raises(error):
            call([rec(1, bad)])
    with pytest.raises(error):
        c.search(bad, 0)
    assert c.is_empty()


def test_batch_faults_name_the_smallest_id(spark):
    df = spark.createDataFrame([(3, [1.0]), (2, [float("nan")]), (1, [1.0, 2.0])], "id long, vector array<float>")
    with pytest.raises(InvalidVector):
        check_rows(df, None)
    with pytest.raises(InvalidId):
        check_rows(spark.createDataFrame([(-1, [1.0])], "id long, vector array<float>"), None)
    twice = spark.createDataFrame([(4, [1.0]), (4, [2.0])], "id long, vector array<float>")
    with pytest.raises(DuplicateId):
        mutate.insert(spark.createDataFrame([], RECORD), twice, None)
    with pytest.raises(InvalidVector, match="greater than zero"):
        Collection.create(spark, 0)


def test_upsert_moves_and_over_fetch(spark):
    c = Collection.create(spark, index=graph_index(GraphParams(4, 16, 16)))
    c.insert([rec(i, [1 - 0.05 * i, 0.05 * i]) for i in range(10)])
    c.search([1.0, 0.0], 1).collect()
    c.delete([0, 1, 2])
    hits = c.search([1.0, 0.0], 3).collect()
    assert len(hits) == 3 and not {r["id"] for r in hits} & {0, 1, 2}
    assert c.tombstones == 3
    clone = c.clone()
    assert c.compact() == 3 and c.compact() == 0 and c.count() == 7
    assert clone.tombstones == 0 and clone.count() == 7
    c.insert([rec(1, [0.5, 0.5])])
    assert c.count() == 8 and [r["id"] for r in c.search([0.5, 0.5], 8).collect()].count(1) == 1
    c.delete([5, 6])
    c.insert([rec(77, [0.2, 0.8])])  # a fresh id leaves tombstones alone
    assert c.tombstones == 2 and c.count() == 7 and not {5, 6} & {r["id"] for r in c.search([1.0, 0.0], 20).collect()}
    c.upsert([rec(5, [0.1, 0.9])])  # a deleted id in use again
    assert c.tombstones == 0 and c.count() == 8
    d = Collection.create(spark)
    d.insert([rec(1, [1.0, 0.0]), rec(2, [-1.0, 0.0])])
    d.upsert([rec(1, [0.0, 1.0])])
    top = d.search([0.0, 1.0], 1).first()
    assert top["id"] == 1 and top["score"] == pytest.approx(1, abs=1e-6)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["insert", "upsert", "delete"]), st.integers(0, 3), st.floats(0.125, 1, width=32)), max_size=6))
def test_mutations_follow_a_dictionary(spark, steps):
    c, model = Collection.create(spark, 2), {}
    for op, id, x in steps:
        try:
            if op == "delete":
                c.delete(id)
                ok = id in model
                model.pop(id)
            else:
                getattr(c, op)([rec(id, [x, 1.0])])
                ok = op == "upsert" or id not in model
                model[id] = x
        except (DuplicateId, NotFound):
            ok = (op == "insert" and id in model) or (op == "delete" and id not in model)
        assert ok
    assert {r["id"]: r["vector"][0] for r in c.records.collect()} == model


def filled(spark, vec, n=20, dim=16, **kw):
    c = Collection.create(spark, dim, **kw)
    c.insert([rec(i, vec(i, dim), f"record {i}", p=str(i % 2)) for i in range(n)])
    return c


def test_save_load_lazy_and_quantized(spark, vec, tmp_path):
    c = filled(spark, vec, index=graph_index())
    want = [(r["id"], r["score"]) for r in c.search(vec(100, 16), 5).collect()]
    path = f"{tmp_path}/c"
    c.save(path)
    back = Collection.load(spark, path)
    assert [(r["id"], r["score"]) for r in back.search(vec(100, 16), 5).collect()] == want
    assert back.index == c.index and back.dimension == 16 and back._graph.graph is not None
    back.delete(3)
    back.save(path)  # tombstones pending: no graph goes along
    assert store.read_manifest(spark, path)["graph"] is None and Collection.load(spark, path).count() == 19
    lazy = LazyCollection(spark, path)
    exact = [(r["id"], r["score"]) for r in Collection.load(spark, path).search(vec(5, 16), 4, {"p": "1"}).collect()]
    assert [(r["id"], r["score"]) for r in lazy.search(vec(5, 16), 4, {"p": "1"}).collect()] == exact
    with pytest.raises(DimensionMismatch):
        lazy.search([1.0], 3)
    q = filled(spark, vec)
    q.set_encoding(SCALAR8)
    q.save(f"{tmp_path}/q")
    again = Collection.load(spark, f"{tmp_path}/q")
    assert again.search(vec(3, 16), 1).first()["id"] == 3 and again.encoding == SCALAR8
    e = Collection.create(spark)
    e.save(f"{tmp_path}/e")
    assert Collection.load(spark, f"{tmp_path}/e").is_empty() and LazyCollection(spark, f"{tmp_path}/e").is_empty()


def test_corruption_is_noticed(spark, vec, tmp_path):
    path = tmp_path / "c"
    filled(spark, vec).save(str(path))
    manifest = path / "manifest.json"
    good = manifest.read_text()
    with pytest.raises(StorageError):
        Collection.load(spark, str(tmp_path / "none"))
    for text, error in (("{", Corrupt), (good.replace('"rows": 20', '"rows": 21'), Corrupt), (good.replace("vector-collection", "x"), Corrupt)):
        manifest.write_text(text)
        (path / ".manifest.json.crc").unlink(missing_ok=True)
        with pytest.raises(error):
            Collection.load(spark, str(path))
    import zlib

    body = json.loads(good)["body"] | {"major": 2}
    manifest.write_text(json.dumps({"crc32": zlib.crc32(json.dumps(body, sort_keys=True).encode()), "body": body}))
    with pytest.raises(UnsupportedVersion, match="2.0"):
        Collection.load(spark, str(path))
    body = json.loads(good)["body"] | {"checksum": 1}
    manifest.write_text(json.dumps({"crc32": zlib.crc32(json.dumps(body, sort_keys=True).encode()), "body": body}))
    with pytest.raises(Corrupt, match="checksum of the records"):
        Collection.load(spark, str(path))


def test_graph_validation(spark, vec):
    r = spark.createDataFrame([(1, vec(1, 4), "", {}), (2, vec(2, 4), "", {})], RECORD)
    for rows in ([(0, 0, 9, [])], [(0, 0, 1, [5])], [(0, 3, 1, [])]):
        g = spark.createDataFrame(rows, "shard int, node int, id long, neighbors array<int>")
        with pytest.raises(Corrupt):
            nsw.check_graph(g, r)


def test_json_bridge(spark, vec, tmp_path):
    c = filled(spark, vec, n=5, index=graph_index(GraphParams(8, 32, 32)))
    path = f"{tmp_path}/c.json"
    c.export_json(path)
    back = Collection.import_json(spark, path)
    assert back.index == c.index and back.dimension == 16
    assert sorted(map(tuple, back.records.select("id", "text").collect())) == sorted(map(tuple, c.records.select("id", "text").collect()))
    assert back.get(3)["vector"] == c.get(3)["vector"] and back.get(3)["metadata"] == {"p": "1"}
    (tmp_path / "min.json").write_text('{"records": {"7": {"id": 7, "vector": [1, 2], "text": "x"}}}')
    m = Collection.import_json(spark, f"{tmp_path}/min.json")
    assert m.dimension == 2 and m.index.params is None and m.get(7)["metadata"] == {}
    (tmp_path / "kind.json").write_text('{"dimension": null, "index_kind": "Exact", "records": {}}')
    assert Collection.import_json(spark, f"{tmp_path}/kind.json").index.params is None
    (tmp_path / "odd.json").write_text('{"index_kind": {"Tree": {}}, "records": {}}')
    with pytest.raises(SerializationError):
        Collection.import_json(spark, f"{tmp_path}/odd.json")
    (tmp_path / "none.json").write_text("{}")
    assert Collection.import_json(spark, f"{tmp_path}/none.json").is_empty()
    (tmp_path / "bad.json").write_text('{"records": {"8": {"id": 7, "vector": [1, 2], "text": "x"}}}')
    (tmp_path / "broken.json").write_text('{"records": ')
    for name in ("bad", "broken"):
        with pytest.raises(SerializationError):
            Collection.import_json(spark, f"{tmp_path}/{name}.json")


def test_command_line(spark, tmp_path, capsys):
    path = str(tmp_path / "c")

    def call(*args, code=0):
        assert cli.main([*args], spark) == code
        out = capsys.readouterr()
        return out.out if code == 0 else out.err

    assert "dim=3" in call("create", path, "--dim", "3")
    call("insert", path, "--id", "1", "--vector", "1,0,0", "--text", "first", "--meta", "topic=rust")
    call("insert", path, "--id", "2", "--vector", "[0 0 1]", "--text", "second")
    out = call("search", path, "--vector", ".9,0,.1", "-k", "1")
    assert "id=1" in out and "id=2" not in out and out.startswith(" 1. [0.99")
    assert "id=1" in (out := call("search", path, "--vector", "0,0,1", "--filter", "topic=rust", "--lazy")) and "id=2" not in out
    assert "no results" in call("search", path, "--vector", "0,0,1", "--filter", "topic=none")
    out = call("stats", path)
    assert "records:   2" in out and "dimension: 3" in out
    assert "already exists" in call("insert", path, "--id", "1", "--vector", "1,0,0", code=1)
    call("insert", path, "--id", "1", "--vector", "0,1,0", "--upsert")
    call("export", path, f"{tmp_path}/c.json")
    call("import", f"{tmp_path}/c.json", f"{tmp_path}/d")
    assert "records:   2" in call("stats", f"{tmp_path}/d")
    call("delete", path, "--id", "2")
    call("compact", path)
    assert "records:   1" in call("stats", path)
    assert "int8" in call("create", f"{tmp_path}/q", "--dim", "2", "--encoding", "int8", "--index", "graph")
    (tmp_path / "v.txt").write_text("0 1 0")
    assert "id=1" in call("search", path, f"--vector=@{tmp_path}/v.txt")
    for bad in (["nonsense"], ["insert", path], ["search", path, "--vector", "x"], ["search", path, "--vector", "1,2,3", "--filter", "x"], ["delete", path, "--id", "99"]):
        assert "error:" in call(*bad, code=1)
    assert "usage" in call() and "usage" in call("help")
    cli.demo(spark)
    assert capsys.readouterr().out.splitlines()[0].startswith("[0.996] 1")


def test_stream_upserts(spark, tmp_path):
    path = f"{tmp_path}/c"
    Collection.create(spark, 2).save(path)
    rows = [(1, [1.0, 0.0], "old", 1), (1, [0.0, 1.0], "new", 2), (2, [1.0, 1.0], "two", 1), (3, [1.0], "short", 1)]
    schema = "id long, vector array<float>, text string, version int"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    for _ in range(2):
        q = upsert_stream(stream, path, checkpoint=f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(120)
        c = Collection.load(spark, path)
        assert sorted((r["id"], r["text"]) for r in c.records.select("id", "text").collect()) == [(1, "new"), (2, "two")]
        bad = spark.read.parquet(f"{path}-rejected")
        assert [(r["id"], r["why"], r["text"]) for r in bad.collect()] == [(3, "dimension", "short")]
    assert c.search_batch(spark.createDataFrame([(9, [0.0, 1.0])], "query_id long, query_vector array<float>"), 1).first()["id"] == 1
    assert c.records.where(F.size("vector") != 2).isEmpty()


def test_json_lines(spark, vec, tmp_path):
    c = Collection.create(spark, 8)
    c.insert([rec(i, vec(i, 8), f"line\n{i}", k="v") for i in range(20)])
    c.export_json_lines(f"{tmp_path}/lines")
    back = Collection.import_json_lines(spark, f"{tmp_path}/lines")
    assert back.dimension == 8 and sorted(map(str, back.records.collect())) == sorted(map(str, c.records.collect()))
    with open(f"{tmp_path}/bad.json", "w") as f:
        f.write('{"id": 1, "vector": [1.0]}\n{"id": 2\n')
    with pytest.raises(SerializationError):
        Collection.import_json_lines(spark, f"{tmp_path}/bad.json")


def test_a_loaded_graph_takes_inserts(spark, vec, tmp_path):
    from vectide.schema import graph_index

    c = Collection.create(spark, 8, graph_index())
    c.insert([rec(i, vec(i, 8)) for i in range(30)])
    c.save(f"{tmp_path}/c")
    back = Collection.load(spark, f"{tmp_path}/c")
    back.insert([rec(i, vec(i, 8)) for i in range(30, 40)])
    assert back._graph.graph is not None and back.search(vec(35, 8), 1).first()["id"] == 35
    back.save(f"{tmp_path}/c")
    back.save(f"{tmp_path}/c")
    assert back.search(vec(36, 8), 1).first()["id"] == 36
    assert Collection.load(spark, f"{tmp_path}/c").search(vec(37, 8), 1).first()["id"] == 37
    assert back.stats() == {"records": 40, "dimension": 8, "index": "graph(M=16, ef_construction=64, ef_search=64)", "encoding": "float32"}
