"""Occurrences and record counts of every term by an external sort.

(key, term, record id) triples are range-partitioned on all three columns and sorted in each partition by Spark's
spilling sort; a run-length scan over the sorted stream counts occurrences and distinct records. As the ranges include
the record id, a term of a third of all rows spreads over many partitions; its partial runs are added up at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.plans.scratch import Scratch

_SPACE = r"[\s\p{Z}\x{0b}\x{85}\x{1c}-\x{1f}]+"
_RUNS = "meta_key string, term string, occurrences long, records long"


def term_counts(records: DataFrame, metadata: str = "metadata", id: str = "id", list_keys: tuple[str, ...] = ("tags",)) -> DataFrame:
    """``meta_key, term, occurrences, records`` of each term of a string map.

    Values of ``list_keys`` are cut at ``;``, ``,`` and ``|``; any other value is one term. Terms are stripped of white space at both ends, lower-cased, and dropped if empty. ``records`` counts distinct ids;
    rows that repeat an id count once, and all rows with a null id count as one record. Null maps, null values and
    empty tables give no terms. Other columns, whatever their names, are never read.
    """
    cells = records.select(records[id].alias("id"), F.explode(records[metadata]).alias("meta_key", "value"))
    pieces = F.when(F.col("meta_key").isin(*list_keys), F.split("value", "[;,|]")).otherwise(F.array("value"))
    clean = F.transform(pieces, lambda x: F.lower(F.regexp_replace(x, f"^{_SPACE}|{_SPACE}$", "")))
    terms = F.filter(clean, lambda x: x.isNotNull() & (x != ""))
    # a record's repeats of a term are combined before the shuffle
    once = F.transform(F.array_distinct(terms), lambda t: F.struct(t.alias("t"), F.size(F.filter(terms, lambda x: x == t)).alias("n")))
    triples = cells.select("meta_key", "id", F.explode(once).alias("e")).select(
        "meta_key", F.col("e.t").alias("term"), F.coalesce(F.col("id").cast("long"), F.lit(0)).alias("id"), F.col("e.n").alias("n"), F.col("id").isNull().alias("nameless"))
    key = ["meta_key", "term", "nameless", "id"]
    runs = triples.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(_scan, _RUNS)
    return runs.groupBy("meta_key", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def _scan(batches):
    """Run lengths of a sorted stream, batch by batch; the last run of a batch may go on in the next."""
    held = None  # (key, term, occurrences, records, last record)
    for b in batches:
        if not b.num_rows:
            continue
        k, t = b.column(0), b.column(1)
        ids, n, nameless = b.column(2).to_numpy(), b.column(3).to_numpy().astype(np.int64), b.column(4).to_numpy(zero_copy_only=False)
        new_term = np.ones(b.num_rows, bool)
        if b.num_rows > 1:
            new_term[1:] = pc.or_(pc.not_equal(k.slice(1), k.slice(0, b.num_rows - 1)), pc.not_equal(t.slice(1), t.slice(0, b.num_rows - 1))).to_numpy(zero_copy_only=False)
        new_id = new_term.copy()
        new_id[1:] |= (ids[1:] != ids[:-1]) | (nameless[1:] != nameless[:-1])
        at = np.flatnonzero(new_term)
        occ, rec = np.add.reduceat(n, at), np.add.reduceat(new_id.astype(np.int64), at)
        keys, terms = k.take(pa.array(at)).to_pylist(), t.take(pa.array(at)).to_pylist()
        if held is not None:
            if (held[0], held[1]) == (keys[0], terms[0]):
                occ[0] += held[2]
                rec[0] += held[3] - (held[4] == (ids[0], nameless[0]))
            else:
                yield _batch([held[0]], [held[1]], [held[2]], [held[3]])
        held = (keys[-1], terms[-1], int(occ[-1]), int(rec[-1]), (ids[-1], nameless[-1]))
        if len(at) > 1:
            yield _batch(keys[:-1], terms[:-1], occ[:-1], rec[:-1])
    if held is not None:
        yield _batch([held[0]], [held[1]], [held[2]], [held[3]])


def _batch(k, t, o, r):
    return pa.RecordBatch.from_arrays(
        [pa.array(k, pa.string()), pa.array(t, pa.string()), pa.array(o, pa.int64()), pa.array(r, pa.int64())],
        names=["meta_key", "term", "occurrences", "records"])


def term_frequencies(records: DataFrame, *, rare_below: int = 3, common_above: float = 0.05, **kw) -> DataFrame:
    """``term_counts`` with ``mark``: ``rare`` (fewer than ``rare_below`` records), ``common`` (more than the share
    ``common_above`` of all rows) or ``kept``. A term that is both, in a tiny table, is ``rare``."""
    total = records.count()
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > common_above * total, "common")
    return term_counts(records, **kw).withColumn("mark", mark.otherwise("kept"))


def p5_found(spark, sf_dir: str) -> DataFrame:
    marked = term_frequencies(spark.read.parquet(f"{sf_dir}/records.parquet").select("id", "metadata"))
    return marked.where(F.col("mark") != "kept").select("meta_key", "term")


def p5_terms(spark, sf_dir: str) -> DataFrame:
    return term_frequencies(spark.read.parquet(f"{sf_dir}/records.parquet").select("id", "metadata"))


_SQL = r"""
WITH e AS (SELECT id, unnest(map_entries(metadata)) AS kv FROM records),
p AS (SELECT id, kv.key AS meta_key, unnest(CASE WHEN kv.key = 'tags' THEN string_split_regex(kv.value, '[;,|]') ELSE [kv.value] END) AS x FROM e),
t AS (SELECT id, meta_key, lower(regexp_replace(x, '^[\s\p{Z}\x{0b}\x{85}\x{1c}-\x{1f}]+|[\s\p{Z}\x{0b}\x{85}\x{1c}-\x{1f}]+$', '', 'g')) AS term FROM p),
c AS (SELECT meta_key, term, count(*) AS occurrences, count(DISTINCT id) AS records FROM t WHERE term <> '' GROUP BY ALL),
m AS (SELECT *, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.05 * (SELECT count(*) FROM records) THEN 'common' ELSE 'kept' END AS mark FROM c)
"""

QUERIES = {"p5_found": p5_found, "p5_terms": p5_terms}
SQL = {"p5_found": _SQL + "SELECT meta_key, term FROM m WHERE mark <> 'kept'", "p5_terms": _SQL + "SELECT meta_key, term, occurrences, records, mark FROM m"}
