"""Collections on disk: one Parquet snapshot and one manifest a collection.

A save writes a new snapshot folder and then replaces the manifest in one rename; readers follow the manifest, so they see
the old state or the new one. Vectors are stored as floats or, quantized, as 8-bit codes with the bounds in the manifest.
The manifest holds a row count and a checksum over ids and stored vectors, checked on load.
"""

from __future__ import annotations

import json
import uuid
import zlib
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vectide.errors import Corrupt, SerializationError, StorageError, UnsupportedVersion
from vectide.functions import vecmath as vm
from vectide.functions.validate import check_rows, vector_fault
from vectide.operators.graph import assemble, check_graph, structure
from vectide.operators.mutate import as_records
from vectide.schema import EXACT, FLOAT32, RECORD, SCALAR8, GraphParams, IndexKind, graph_index
from vectide.sources import files

MAGIC, MAJOR, MINOR = "vector-collection", 1, 0
MANIFEST = "manifest.json"


@dataclass
class Stored:
    records: DataFrame
    dimension: int | None
    index: IndexKind
    encoding: str
    graph: DataFrame | None
    rows: int


def _row_sum() -> Column:
    """Aggregate over stored rows: an order-free sum, so that it is computed in parallel."""
    row = F.crc32(F.to_json(F.struct("id", "vector", "text", F.array_sort(F.map_entries("metadata")).alias("m"))).cast("binary"))
    return F.coalesce(F.sum(row), F.lit(0)).alias("sum")


def save(spark: SparkSession, path: str, records: DataFrame, *, dimension: int | None, index: IndexKind, encoding: str, graph: DataFrame | None = None) -> None:
    snapshot = f"records-{uuid.uuid4().hex[:12]}"
    before = _snapshots(spark, path)
    low = high = 0.0
    stored = records.select(*RECORD.names)
    if encoding == SCALAR8:
        low, high = stored.agg(*vm.bounds(F.col("vector"))).first()
        codes = vm.quantize(F.col("vector"), F.lit(low).cast("float"), F.lit(high).cast("float"))
        stored = stored.withColumn("vector", codes)
    seen = Observation()  # rows are counted and summed while they are written
    stored.observe(seen, F.count(F.lit(1)).alias("rows"), _row_sum()).write.parquet(f"{path}/{snapshot}")
    about = {
        "magic": MAGIC, "major": MAJOR, "minor": MINOR, "dimension": dimension, "encoding": encoding, "index": index.name,
        "params": asdict(index.params) if index.params else None, "snapshot": snapshot, "rows": seen.get["rows"],
        "checksum": int(seen.get["sum"]), "qmin": float(low), "qmax": float(high), "graph": None,
    }
    if graph is not None:
        about["graph"] = f"graph-{uuid.uuid4().hex[:12]}"
        structure(graph).write.parquet(f"{path}/{about['graph']}")
    body = json.dumps(about, sort_keys=True)
    files.write_text(spark, f"{path}/{MANIFEST}", json.dumps({"crc32": zlib.crc32(body.encode()), "body": about}, sort_keys=True, indent=1))
    # the snapshot before this one stays for its readers; older ones go
    for name in files.names(spark, path):
        if name.startswith(("records-", "graph-")) and name not in (snapshot, about["graph"], *before):
            files.remove(spark, f"{path}/{name}")


def _snapshots(spark: SparkSession, path: str) -> list[str]:
    try:
        about = json.loads(files.read_text(spark, f"{path}/{MANIFEST}"))["body"]
        return [about["snapshot"], about["graph"]]
    except (StorageError, ValueError, KeyError, TypeError):
        return []


def read_manifest(spark: SparkSession, path: str) -> dict:
    """Checks in order: form, kind, checksum of the manifest, version, encoding, index."""
    try:
        doc = json.loads(files.read_text(spark, f"{path}/{MANIFEST}"))
        about, crc = doc["body"], doc["crc32"]
    except (ValueError, KeyError, TypeError) as e:
        raise Corrupt(f"the manifest can't be read ({e})") from None
    if not isinstance(about, dict) or about.get("magic") != MAGIC:
        raise Corrupt("not a collection")
    if zlib.crc32(json.dumps(about, sort_keys=True).encode()) != crc:
        raise Corrupt("checksum of the manifest")
    if about["major"] != MAJOR:
        raise UnsupportedVersion(f"{about['major']}.{about['minor']}")
    if about["encoding"] not in (FLOAT32, SCALAR8):
        raise Corrupt(f"unknown encoding {about['encoding']}")
    if about["index"] not in ("exact", "graph"):
        raise Corrupt(f"unknown index {about['index']}")
    return about


def scan(spark: SparkSession, path: str, about: dict) -> DataFrame:
    """Lazy scan with vectors as floats; only the columns a query needs are read."""
    if not files.exists(spark, f"{path}/{about['snapshot']}"):
        raise Corrupt("the snapshot is missing")
    return spark.read.parquet(f"{path}/{about['snapshot']}").withColumn("vector", _floats(about)).select(*RECORD.names)


def _floats(about: dict) -> Column:
    v = F.col("vector")
    return v if about["encoding"] != SCALAR8 else vm.dequantize(v, F.lit(about["qmin"]).cast("float"), F.lit(about["qmax"]).cast("float"))


def load(spark: SparkSession, path: str) -> Stored:
    about = read_manifest(spark, path)
    records = scan(spark, path, about)
    raw = spark.read.parquet(f"{path}/{about['snapshot']}")
    try:
        fault = vector_fault(_floats(about), about["dimension"])
        seen = raw.agg(_row_sum(), F.count(F.lit(1)).alias("rows"), F.count_if(fault.isNotNull()).alias("bad")).first()
        if seen["sum"] != about["checksum"]:
            raise Corrupt("checksum of the records")
        if seen["rows"] != about["rows"]:
            raise Corrupt(f"{about['rows']} records expected, {seen['rows']} found")
        if seen["bad"]:
            check_rows(records, about["dimension"])
    except Corrupt:
        raise
    except Exception as e:
        if "Parquet" in str(e) or "parquet" in str(e) or "FAILED_READ_FILE" in str(e):
            raise Corrupt(f"records can't be read: {str(e).splitlines()[0][:200]}") from None
        raise
    index = graph_index(GraphParams(**about["params"])) if about["index"] == "graph" else EXACT
    graph = None
    if about["graph"] and about["index"] == "graph":
        links = spark.read.parquet(f"{path}/{about['graph']}")
        check_graph(links, records)
        graph = assemble(links, records)
    return Stored(records, about["dimension"], index, about["encoding"], graph, about["rows"])


def export_json(spark: SparkSession, path: str, records: DataFrame, dimension: int | None, index: IndexKind) -> None:
    """One document ``{dimension, index_kind, records: {id: record}}`` (kind: "Exact" or {"Hnsw": parameters}). Rows pass
    through the driver one by one in id order and none is kept; ``export_json_lines`` is the parallel form."""
    kind = {"Hnsw": asdict(index.params)} if index.params else "Exact"
    head = json.dumps({"dimension": dimension, "index_kind": kind})

    def lines():
        yield head[:-1] + ', "records": {\n'
        between = ""
        for r in records.select("id", F.to_json(F.struct(*RECORD.names)).alias("j")).orderBy("id").toLocalIterator():
            yield f'{between}  "{r["id"]}": {r["j"]}'
            between = ",\n"
        yield "\n}}\n"

    files.write_text(spark, path, lines())


def export_json_lines(records: DataFrame, path: str) -> None:
    records.select(*RECORD.names).write.json(path)


def import_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON lines; a line that is none, or has no id or vector, fails."""
    rows = spark.read.schema("id long, vector array<float>, text string, metadata map<string,string>, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    wrong = rows.where("_corrupt IS NOT NULL OR id IS NULL OR vector IS NULL").limit(1).collect()
    if wrong:
        raise SerializationError(f"{path} holds a line that is no record")
    return as_records(rows.drop("_corrupt"))


def import_json(spark: SparkSession, path: str) -> tuple[DataFrame, int | None, IndexKind]:
    """Missing ``records``, ``index_kind`` and ``metadata`` have their defaults. Keys must equal the ids they stand for."""
    shape = f"dimension int, index_kind string, records map<string,{RECORD.simpleString()}>, _corrupt string"
    if not files.exists(spark, path):
        raise StorageError(f"no such file: {path}")
    doc = spark.read.schema(shape).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    head = doc.select("dimension", "index_kind", "_corrupt").collect()
    if len(head) != 1 or head[0]["_corrupt"] is not None:
        raise SerializationError(f"{path} is not one collection document")
    e = doc.select(F.explode(F.coalesce("records", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{RECORD.simpleString()}>")))).alias("key", "r"))
    wrong = e.where("r.id IS NULL OR key != cast(r.id AS string) OR r.vector IS NULL").limit(1).collect()
    if wrong:
        raise SerializationError(f"record under key {wrong[0]['key']} has another id or no vector")
    rows = as_records(e.select("r.*"))
    dimension = check_rows(rows, head[0]["dimension"])
    return rows, dimension, _kind(head[0]["index_kind"])


def _kind(text: str | None) -> IndexKind:
    if text is None or text == "Exact":
        return EXACT
    try:
        return graph_index(GraphParams(**json.loads(text)["Hnsw"]))
    except (ValueError, KeyError, TypeError):
        raise SerializationError(f"unknown index kind {text}") from None


__all__ = ["Stored", "export_json", "export_json_lines", "import_json", "import_json_lines", "load", "read_manifest", "save", "scan"]
