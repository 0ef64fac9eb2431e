"""Queries of the core over the driver's tables, and the SQL that gives the same rows.

Records are the rows of ``embeddings`` with the text of the document of the same number and metadata from label, language
and source. Scores are compared as doubles rounded to 6 decimals; order uses the unrounded 32-bit score on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.collection import Collection, LazyCollection
from vectide.functions import vecmath as vm
from vectide.functions.text import parse_vector_column
from vectide.functions.validate import vector_fault
from vectide.operators import graph as nsw
from vectide.operators import mutate
from vectide.operators.search import batch_knn as _batch_knn
from vectide.operators.search import exact_topk as _exact_topk
from vectide.operators.search import recall_at_k, resolve, scored
from vectide.plans.scratch import Scratch
from vectide.schema import EXACT, SCALAR8, GraphParams, graph_index
from vectide.sources import store

#: The record whose vector is the query of single searches.
QUERY_ID = 7


def records(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source")
    entries = F.array(F.struct(F.lit("label").alias("k"), F.col("label").cast("string").alias("v")), F.struct(F.lit("lang").alias("k"), F.col("lang").alias("v")), F.struct(F.lit("source").alias("k"), F.col("source").alias("v")))
    return e.join(d, e["vec_id"] == d["doc_id"], "left").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.coalesce("text", F.lit("")).alias("text"),
        F.map_from_entries(F.filter(entries, lambda x: x["v"].isNotNull())).alias("metadata"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _query(spark: SparkSession, sf: str) -> list[float]:
    return list(vectors(spark, sf).where(F.col("id") == QUERY_ID).first()["vector"])


def _score():
    return F.round(F.col("score").cast("double"), 6).alias("score")


def _top(df: DataFrame) -> DataFrame:
    return df.select("id", _score())


# SQL pieces -----------------------------------------------------------------------------------------------------------
def _dot(a: str, b: str) -> str:
    return f"list_reduce(list_transform(list_zip({a}, {b}), lambda t: (t[1] * t[2])::FLOAT), lambda x, y: (x + y)::FLOAT)"


def _norm(a: str) -> str:
    return f"CAST(sqrt(list_reduce(list_transform({a}, lambda x: (x * x)::FLOAT), lambda x, y: (x + y)::FLOAT)) AS FLOAT)"


def _cos(a: str, b: str) -> str:
    n = f"({_norm(a)} * {_norm(b)})::FLOAT"
    return f"CASE WHEN {n} = 0 THEN 0::FLOAT ELSE CAST({_dot(a, b)}::DOUBLE / ({n})::DOUBLE AS FLOAT) END"


_Q = f"(SELECT embedding FROM embeddings WHERE vec_id = {QUERY_ID})"
_V = "SELECT vec_id AS id, embedding AS vector, label FROM embeddings"
_R = "SELECT vec_id AS id, embedding AS vector, coalesce(text, '') AS text, label, lang, source FROM embeddings LEFT JOIN documents ON vec_id = doc_id"


def _ranked(base: str, k: int | None, cond: str = "true", query: str = _Q) -> str:
    limit = "" if k is None else f"LIMIT {k}"
    return (f"WITH b AS ({base}), s AS (SELECT b.id, {_cos('b.vector', 'q.v')} AS score FROM b, (SELECT {query} AS v) q WHERE {cond}) "
            f"SELECT id, round(score::DOUBLE, 6) AS score FROM (SELECT * FROM s ORDER BY score DESC, id {limit})")


# search ---------------------------------------------------------------------------------------------------------------
def exact_topk(spark, sf):
    return _top(_exact_topk(vectors(spark, sf), _query(spark, sf), 10))


def _collection(spark, sf, index=EXACT) -> Collection:
    return Collection(spark, mutate.as_records(records(spark, sf)), 64, index)


def filtered_topk_label(spark, sf):
    return _top(_collection(spark, sf).search(_query(spark, sf), 10, {"label": "3"}))


def filtered_topk_lang_label(spark, sf):
    return _top(_exact_topk(records(spark, sf), _query(spark, sf), 10, {"label": "3", "lang": "en"}))


def topk_zero_match_filter(spark, sf):
    return _top(_exact_topk(records(spark, sf), _query(spark, sf), 10, {"label": "no such label"}))


def topk_k_exceeds_n(spark, sf):
    return _top(_exact_topk(vectors(spark, sf), _query(spark, sf), 1_000_000))


def topk_k_zero(spark, sf):
    return _top(_exact_topk(vectors(spark, sf), _query(spark, sf), 0))


def all_scores(spark, sf):
    return _top(scored(vectors(spark, sf), _query(spark, sf)))


def tie_break_by_id(spark, sf):
    v = vectors(spark, sf)
    return _top(_exact_topk(v.unionByName(v.withColumn("id", F.col("id") + 1_000_000)), _query(spark, sf), 20))


def zero_vector_scores_zero(spark, sf):
    v = vectors(spark, sf).withColumn("vector", F.when(F.col("label") == 0, F.transform("vector", lambda x: F.lit(0).cast("float"))).otherwise(F.col("vector")))
    return _top(scored(v, _query(spark, sf)))


_KNN_Q = "SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 50 = 0"


def _queries(spark, sf):
    return vectors(spark, sf).where(F.col("id") % 50 == 0).select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))


def batch_knn(spark, sf):
    return _batch_knn(vectors(spark, sf), _queries(spark, sf), 10).select("query_id", "id", _score(), "rank")


def batch_knn_filtered(spark, sf):
    return _batch_knn(records(spark, sf), _queries(spark, sf), 5, {"label": "3"}).select("query_id", "id", _score(), "rank")


def _batch_sql(base: str, k: int, cond: str = "true") -> str:
    return (f"WITH b AS ({base}), q AS ({_KNN_Q}), s AS (SELECT query_id, id, {_cos('b.vector', 'q.qv')} AS score FROM b, q WHERE {cond}), "
            f"r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) "
            f"SELECT query_id, id, round(score::DOUBLE, 6) AS score, rank::INTEGER AS rank FROM r WHERE rank <= {k}")


def resolve_payload(spark, sf):
    r = records(spark, sf)
    hits = _exact_topk(vectors(spark, sf), _query(spark, sf), 10).select("id", "score")
    return resolve(hits, r).select("id", _score(), "text", F.col("metadata")["label"].alias("label"), F.col("metadata")["lang"].alias("lang"))


def get_by_id(spark, sf):
    r = _collection(spark, sf).get(QUERY_ID)
    return spark.createDataFrame([(r["id"], r["text"], r["metadata"]["label"], len(r["vector"]))], "id long, text string, label string, dimension int")


def stats(spark, sf):
    """Of a collection that was saved with 8-bit vectors and a graph, and loaded again."""
    path = Scratch(spark, "store").path("collection")
    c = _collection(spark, sf, graph_index())
    c.set_encoding(SCALAR8)
    c.save(path)
    s = Collection.load(spark, path).stats()
    return spark.createDataFrame([tuple(s.values())], "records long, dimension int, index string, encoding string")


# mutations ------------------------------------------------------------------------------------------------------------
def _shown(df: DataFrame) -> DataFrame:
    return df.select("id", F.round(F.col("vector")[0].cast("double"), 6).alias("v0"), F.size("vector").alias("dimension"), F.coalesce(F.col("metadata")["label"], F.lit("none")).alias("label"))


def _whole(df: DataFrame) -> DataFrame:
    """Every field: the vector as a sum of thousandths weighted by place, the text as its digest."""
    thousandths = F.transform("vector", lambda x, i: F.round(x.cast("double") * 1000).cast("long") * (i + 1))
    return df.select("id", F.aggregate(thousandths, F.lit(0).cast("long"), lambda s, x: s + x).alias("vector_sum"), F.md5("text").alias("text"), *(F.col("metadata")[k].alias(k) for k in ("label", "lang", "source")))


def _shifted(r: DataFrame) -> DataFrame:
    return r.select((F.col("id") + 1_000_000).alias("id"), "vector", "text", "metadata")


def insert_batch(spark, sf):
    r = records(spark, sf)
    return _shown(mutate.insert(mutate.as_records(r), _shifted(r), None)[0])


def _negated(r: DataFrame) -> DataFrame:
    return r.where(F.col("metadata")["label"] == "3").select("id", F.transform("vector", lambda x: -x).alias("vector"), "text", F.create_map(F.lit("label"), F.lit("new")).alias("metadata"))


def upsert_batch(spark, sf):
    r = records(spark, sf)
    return _shown(mutate.upsert(mutate.as_records(r), _negated(r).unionByName(_shifted(r)), None)[0])


def _some(r: DataFrame) -> DataFrame:
    return r.where(F.col("metadata")["label"].isin("3", "5")).select("id")


def delete_batch(spark, sf):
    r = records(spark, sf)
    return _shown(mutate.delete(mutate.as_records(r), _some(r))[0])


def deleted_records(spark, sf):
    r = records(spark, sf)
    return _shown(mutate.delete(mutate.as_records(r), _some(r))[1])


def delete_then_reinsert(spark, sf):
    r = mutate.as_records(records(spark, sf))
    kept, removed = mutate.delete(r, _some(r))
    again = removed.withColumn("metadata", F.create_map(F.lit("label"), F.lit("again")))
    return _shown(mutate.insert(kept, again, None)[0])


def search_after_delete(spark, sf):
    c = _collection(spark, sf)
    c.delete(_some(c.records))
    return _top(c.search(_query(spark, sf), 10))


def duplicate_ids(spark, sf):
    """The id that an insert of the table into itself would be refused for."""
    r = records(spark, sf)
    return spark.createDataFrame([(mutate.first_duplicate(r, r),)], "id long")


def validate_vectors(spark, sf):
    v = vectors(spark, sf)
    broken = (
        F.when(F.col("label") == 0, F.array().cast("array<float>"))
        .when(F.col("label") == 1, F.transform("vector", lambda x, i: F.when(i == 3, F.lit(float("nan")).cast("float")).otherwise(x)))
        .when(F.col("label") == 2, F.transform("vector", lambda x, i: F.when(i == 5, F.lit(float("-inf")).cast("float")).otherwise(x)))
        .when(F.col("label") == 3, F.slice("vector", 1, 10)).otherwise(F.col("vector")))
    return v.select("id", F.coalesce(vector_fault(broken, 64), F.lit("ok")).alias("fault"))


# quantization, parsing, storage ---------------------------------------------------------------------------------------
def quant_bounds(spark, sf):
    b = vectors(spark, sf).agg(*vm.bounds(F.col("vector")))
    return b.select(F.col("qmin").cast("double").alias("qmin"), F.col("qmax").cast("double").alias("qmax"))


def _coded(spark, sf) -> DataFrame:
    """Codes with the bounds beside them: one row of bounds is broadcast."""
    v = vectors(spark, sf)
    b = v.agg(*vm.bounds(F.col("vector")))
    return v.crossJoin(F.broadcast(b)).withColumn("codes", vm.quantize(F.col("vector"), F.col("qmin"), F.col("qmax")))


def quantize_codes(spark, sf):
    return _coded(spark, sf).select("id", F.array_join(F.transform("codes", lambda x: x.cast("string")), ",").alias("codes"))


def _decoded(spark, sf) -> DataFrame:
    return _coded(spark, sf).withColumn("back", vm.dequantize(F.col("codes"), F.col("qmin"), F.col("qmax")))


def dequantize_error(spark, sf):
    err = F.array_max(F.zip_with("vector", "back", lambda x, y: F.abs(x - y)))
    return _decoded(spark, sf).select("id", F.round(err.cast("double"), 6).alias("worst"))


def quantized_topk(spark, sf):
    d = _decoded(spark, sf).select("id", F.col("back").alias("vector"))
    return _top(_exact_topk(d, _query(spark, sf), 10))


def parse_vector_text(spark, sf):
    line = F.concat(F.lit("[ "), F.array_join(F.transform("vector", lambda x: x.cast("string")), ", "), F.lit(" ]"))
    v = vectors(spark, sf).select("id", parse_vector_column(line).alias("p"), "vector")
    return v.select("id", F.size("p").alias("n"), (F.col("p") == F.col("vector")).alias("same"))


def json_roundtrip(spark, sf):
    path = Scratch(spark, "json").path("doc") + ".json"
    _collection(spark, sf, graph_index()).export_json(path)
    return _whole(Collection.import_json(spark, path).records)


def json_lines_roundtrip(spark, sf):
    path = Scratch(spark, "json").path("lines")
    _collection(spark, sf).export_json_lines(path)
    return _whole(Collection.import_json_lines(spark, path).records)


def parquet_roundtrip(spark, sf):
    path = Scratch(spark, "store").path("collection")
    _collection(spark, sf).save(path)
    return _whole(Collection.load(spark, path).records)


def lazy_search(spark, sf):
    path = Scratch(spark, "store").path("collection")
    _collection(spark, sf).save(path)
    return _top(LazyCollection(spark, path).search(_query(spark, sf), 10, {"label": "3"}))


def quantized_store_search(spark, sf):
    path = Scratch(spark, "store").path("collection")
    store.save(spark, path, mutate.as_records(records(spark, sf)), dimension=64, index=EXACT, encoding=SCALAR8)
    return _top(LazyCollection(spark, path).search(_query(spark, sf), 10))


def crc32_text(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc"))


def compact_counts(spark, sf):
    c = _collection(spark, sf, graph_index())
    c.delete(_some(c.records))
    return spark.createDataFrame([(c.compact(), c.compact(), c.count())], "first int, second int, records long")


# approximate index ----------------------------------------------------------------------------------------------------
def _graph(spark, sf, params=GraphParams(), shards=1) -> DataFrame:
    return Scratch(spark, "graph").table(nsw.build(vectors(spark, sf), params, shards=shards), "graph")


def ann_topk(spark, sf):
    hits = nsw.walk(_graph(spark, sf), [(0, _query(spark, sf))], 10, GraphParams())
    return hits.select("id", _score(), "rank")


def ann_topk_tombstones(spark, sf):
    c = _collection(spark, sf, graph_index())
    c._built()
    c.delete(_some(c.records))
    return c.search(_query(spark, sf), 10).select("id", _score(), "rank")


def ann_exhaustive_topk(spark, sf):
    """With as many candidates as rows the walk visits all that it can reach, here everything."""
    n = vectors(spark, sf).count()
    hits = nsw.walk(_graph(spark, sf, shards=4), [(0, _query(spark, sf))], 10, GraphParams(), ef=n)
    return hits.select("id", _score())


def ann_inserted_topk(spark, sf):
    """The second half of the records is inserted into the graph of the first."""
    c = _collection(spark, sf, graph_index())
    whole = c.records
    c = Collection(spark, whole.where(F.col("id") % 2 == 0), 64, graph_index())
    c._built()
    c.insert(whole.where(F.col("id") % 2 == 1))
    n = whole.count()
    return c.search(_query(spark, sf), 10, ef=n).select("id", _score(), "rank")


def recalls(spark, sf):
    q = _queries(spark, sf)
    asked = [(r["query_id"], list(r["query_vector"])) for r in q.collect()]
    got = nsw.walk(_graph(spark, sf, shards=2), asked, 10, GraphParams())
    return recall_at_k(_batch_knn(vectors(spark, sf), q, 10), got)


def ann_recall(spark, sf):
    """Queries, and whether the mean recall of their ten nearest is at least 0.95."""
    return recalls(spark, sf).agg(F.count(F.lit(1)).alias("queries"), (F.avg("recall") >= 0.95).alias("enough"))


def ann_reachable(spark, sf):
    """Nodes of all shards, and whether at least 99 of 100 are reached from their shard's entry."""
    r = nsw.reachable(_graph(spark, sf, shards=2))
    return r.agg(F.sum("nodes").alias("nodes"), (F.sum("reachable") >= 0.99 * F.sum("nodes")).alias("reached"))


_SHOW = "id, round(v0::DOUBLE, 6) AS v0, dimension, label"
_REC = "SELECT vec_id AS id, embedding[1] AS v0, len(embedding)::INTEGER AS dimension, label::VARCHAR AS label FROM embeddings"
_WHOLE = ("SELECT id, list_sum(list_transform(vector, lambda x, i: round(x::DOUBLE * 1000)::BIGINT * i))::BIGINT AS vector_sum, md5(text) AS text, "
          f"label::VARCHAR AS label, lang, source FROM ({_R})")
_RANK = "SELECT id, score, row_number() OVER ()::INTEGER AS rank FROM ({})"
# a CRC by table, over the bytes of each text
_CRC = """WITH RECURSIVE t AS (
  SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) AS tab
  FROM (SELECT unnest(range(256))::BIGINT AS n)),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, list_transform(range(1, len(h) + 1, 2), lambda i: ((strpos('0123456789ABCDEF', h[i]) - 1) * 16 + strpos('0123456789ABCDEF', h[i + 1]) - 1)::BIGINT) AS bytes FROM d)
SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8)), 4294967295)::BIGINT AS crc FROM b, t"""
_BOUNDS = "SELECT min(x) AS qmin, max(x) AS qmax FROM (SELECT unnest(embedding) AS x FROM embeddings)"
_CODE = "list_transform(vector, lambda x: least(greatest(floor((((x - qmin)::DOUBLE / (qmax - qmin)::DOUBLE)::FLOAT * 255::FLOAT)::DOUBLE + 0.5), 0), 255)::SMALLINT)"
_BACK = "list_transform(codes, lambda c: (qmin + ((c::DOUBLE / 255)::FLOAT * (qmax - qmin)::FLOAT)::FLOAT)::FLOAT)"
_DECODED = f"SELECT id, vector, codes, {_BACK} AS back FROM (SELECT *, {_CODE} AS codes FROM ({_V}), ({_BOUNDS}))"

SQL = {
    "exact_topk": _ranked(_V, 10),
    "filtered_topk_label": _ranked(_R, 10, "label = 3"),
    "filtered_topk_lang_label": _ranked(_R, 10, "label = 3 AND lang = 'en'"),
    "topk_zero_match_filter": _ranked(_R, 10, "label::VARCHAR = 'no such label'"),
    "topk_k_exceeds_n": _ranked(_V, 1_000_000),
    "topk_k_zero": _ranked(_V, 0),
    "all_scores": _ranked(_V, None),
    "tie_break_by_id": _ranked(f"{_V} UNION ALL SELECT vec_id + 1000000, embedding, label FROM embeddings", 20),
    "zero_vector_scores_zero": _ranked("SELECT vec_id AS id, CASE WHEN label = 0 THEN list_transform(embedding, lambda x: 0::FLOAT) ELSE embedding END AS vector FROM embeddings", None),
    "batch_knn": _batch_sql(_V, 10),
    "batch_knn_filtered": _batch_sql(_R, 5, "label = 3"),
    "resolve_payload": f"WITH s AS ({_ranked(_V, 10)}) SELECT s.id, s.score, r.text, r.label::VARCHAR AS label, r.lang FROM s JOIN ({_R}) r ON s.id = r.id",
    "get_by_id": f"SELECT id, text, label::VARCHAR AS label, len(vector)::INTEGER AS dimension FROM ({_R}) WHERE id = {QUERY_ID}",
    "stats": "SELECT count(*) AS records, max(len(embedding))::INTEGER AS dimension, 'graph(M=16, ef_construction=64, ef_search=64)' AS index, 'int8 (scalar-quantized)' AS encoding FROM embeddings",
    "insert_batch": f"WITH r AS ({_REC}), a AS (SELECT * FROM r UNION ALL SELECT id + 1000000, v0, dimension, label FROM r) SELECT {_SHOW} FROM a",
    "upsert_batch": f"WITH r AS ({_REC}), a AS (SELECT * FROM r WHERE label <> '3' UNION ALL SELECT id, -v0, dimension, 'new' FROM r WHERE label = '3' UNION ALL SELECT id + 1000000, v0, dimension, label FROM r) SELECT {_SHOW} FROM a",
    "delete_batch": f"WITH r AS ({_REC}) SELECT {_SHOW} FROM r WHERE label NOT IN ('3', '5')",
    "deleted_records": f"WITH r AS ({_REC}) SELECT {_SHOW} FROM r WHERE label IN ('3', '5')",
    "delete_then_reinsert": f"WITH r AS ({_REC}), a AS (SELECT id, v0, dimension, CASE WHEN label IN ('3', '5') THEN 'again' ELSE label END AS label FROM r) SELECT {_SHOW} FROM a",
    "search_after_delete": _ranked(_V, 10, "label NOT IN (3, 5)"),
    "duplicate_ids": "SELECT min(vec_id) AS id FROM embeddings",
    "validate_vectors": "SELECT vec_id AS id, CASE label WHEN 0 THEN 'vector cannot be empty' WHEN 1 THEN 'all values must be finite' WHEN 2 THEN 'all values must be finite' WHEN 3 THEN 'dimension' ELSE 'ok' END AS fault FROM embeddings",
    "quant_bounds": f"SELECT qmin::DOUBLE AS qmin, qmax::DOUBLE AS qmax FROM ({_BOUNDS})",
    "quantize_codes": f"SELECT id, array_to_string(codes, ',') AS codes FROM ({_DECODED})",
    "dequantize_error": f"SELECT id, round(list_max(list_transform(list_zip(vector, back), lambda t: abs((t[1] - t[2])::FLOAT)))::DOUBLE, 6) AS worst FROM ({_DECODED})",
    "quantized_topk": _ranked(f"SELECT id, back AS vector FROM ({_DECODED})", 10),
    "quantized_store_search": _ranked(f"SELECT id, back AS vector FROM ({_DECODED})", 10),
    "parse_vector_text": "SELECT vec_id AS id, len(embedding)::INTEGER AS n, true AS same FROM embeddings",
    "json_roundtrip": _WHOLE,
    "json_lines_roundtrip": _WHOLE,
    "parquet_roundtrip": _WHOLE,
    "lazy_search": _ranked(_R, 10, "label = 3"),
    "compact_counts": "SELECT count_if(label IN (3, 5))::INTEGER AS first, 0::INTEGER AS second, count_if(label NOT IN (3, 5))::BIGINT AS records FROM embeddings",
    "ann_exhaustive_topk": _ranked(_V, 10),
    "ann_topk": _RANK.format(_ranked(_V, 10)),
    "ann_topk_tombstones": _RANK.format(_ranked(_V, 10, "label NOT IN (3, 5)")),
    "ann_inserted_topk": _RANK.format(_ranked(_V, 10)),
    "ann_recall": "SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 50 = 0",
    "ann_reachable": "SELECT count(*)::BIGINT AS nodes, true AS reached FROM embeddings",
    "crc32_text": _CRC,
}

_QUERIES = [
    exact_topk, filtered_topk_label, filtered_topk_lang_label, topk_zero_match_filter, topk_k_exceeds_n, topk_k_zero, all_scores,
    tie_break_by_id, zero_vector_scores_zero, batch_knn, batch_knn_filtered, resolve_payload, get_by_id, stats, insert_batch,
    upsert_batch, delete_batch, deleted_records, delete_then_reinsert, search_after_delete, duplicate_ids, validate_vectors,
    quant_bounds, quantize_codes, dequantize_error, quantized_topk, quantized_store_search, parse_vector_text, json_roundtrip,
    json_lines_roundtrip, parquet_roundtrip, lazy_search, crc32_text, compact_counts, ann_topk, ann_topk_tombstones, ann_exhaustive_topk, ann_inserted_topk,
    ann_recall, ann_reachable,
]


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
