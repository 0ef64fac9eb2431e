"""Deduplicating batches against all accepted history.

The history is a folder of tables that any later session can open: content-defined chunks of every accepted text, ids,
vector fingerprints and 8-bit vectors by forest leaf. A batch joins its own few keys with these narrow tables; old records
are read again only where they are candidates. Appending a batch writes one new part of each table and then the manifest
that lists the parts, in one rename; every MERGE parts of one level are merged into one of the next, so a table has a few
parts a level after any number of batches and a row is rewritten once a level.

Text. A rolling hash over the bytes of each word of a text (distinct words; a word's end is a boundary as well) sets chunk
boundaries, so texts that differ in a few words share most chunks. A text knows the fewest bytes that it must share with
one whose words overlap enough. Its chunks are ordered from rare to common by a frozen list of the common ones, and only
the rarest are in the chunk-to-record table: those that two such texts can't both lack. Thus chunks held by a third of
all records (common phrases) never form a join, and no pair is lost. Shared byte totals of the candidates decide by
coverage, and the word sets of those that pass are compared exactly.
"""

from __future__ import annotations

import gc
import json
import math
import pickle
import unicodedata
import uuid
from base64 import b64decode, b64encode
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.llm import forest as rp
from vectide.plans.scratch import Scratch, broadcast_if
from vectide.sources import files

DIM = 96
MIN_COS = 0.985
MIN_JACCARD = 0.8
#: Least bytes of a chunk within a word, and the mask of the rolling hash there.
CHUNK_MIN, CHUNK_MASK = 4, 0xF
#: A chunk in more than max(COMMON_ROWS, records / MOST_COMMON) records is common. A record has a bounded number of
#: chunks a byte, so the list of common chunks is bounded by MOST_COMMON times the mean chunks of a record.
COMMON_ROWS, MOST_COMMON = 20, 20_000
TREES, PROBES = 2, 8
COARSE = 0.012
#: Texts or vectors of up to so many rows of a batch are broadcast (20 MB of vectors).
SMALL_TEXTS = 20_000
#: Small batches that wait together are decided in steps of up to so many rows, as many as are sent to the history's tables
#: at once; a larger batch is a step.
STEP_ROWS = rp.SMALL
#: Parts of one level that are merged into one.
MERGE = 8
#: Blocks of searches that are sent to the stored leaves; more searches meet the leaves in a shuffle.
MOST_BLOCKS = 4
#: Ranges of keys by which candidates are fetched.
RANGES = 64

_TABLES = {
    "rows": "key long, id long, text string, vector array<float>",
    "texts": "key long, s1 long, s2 long",
    "chunk_table": "chunk long, key long, n int, bits long",
    "vectors": "key long, h1 long, h2 long",
    "leaves": "leaf int, role byte, id long, vector binary",
    "common": "chunk long, n long",
}

_WORD = regex.compile(r"[\p{L}\p{Nd}]+")
_GEAR = np.frombuffer(np.random.default_rng(5).bytes(256 * 8), np.uint64).tolist()
_M64 = (1 << 64) - 1


def words(text: str | None) -> list[str]:
    """Distinct maximal runs of letters and digits after NFKC and lower-casing, sorted."""
    return sorted(set(_WORD.findall(unicodedata.normalize("NFKC", text).lower()))) if text else []


def chunks(word: str) -> list[tuple[int, int]]:
    """(hash, bytes) of the content-defined chunks of one word. The gear hash of the bytes since the word's start decides
    where a chunk ends; a chunk's hash is that of the word up to its end, so equal chunks stem from equal beginnings."""
    raw, out, start, h = word.encode("utf-8"), [], 0, 0
    for i, byte in enumerate(raw, 1):
        h = ((h << 1) + _GEAR[byte]) & _M64
        if i - start >= CHUNK_MIN and i < len(raw) and (h >> 40) & CHUNK_MASK == 0:
            out.append((xxhash.xxh64_intdigest(raw[:i]) - (1 << 63), i - start))
            start = i
    out.append((xxhash.xxh64_intdigest(raw + b" ") - (1 << 63), len(raw) + 1 - start))
    return out


def least_shared(sizes: list[int], distinct_bytes: int, jaccard: float = MIN_JACCARD) -> int:
    """Fewest chunk bytes shared with any text of that word overlap: the shortest of the words that must be common, less
    the bytes that chunks repeated within the text could hide."""
    common = math.ceil(jaccard * len(sizes) - 1e-9)
    return max(1, sum(sorted(sizes)[:common]) - (sum(sizes) - distinct_bytes))


_CHUNKED = "s1 long, s2 long, hashes array<long>, sizes array<int>, need int, n int, bits long"
_CHUNK_KINDS = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.int64())


def with_chunks(df: DataFrame) -> DataFrame:
    """``df`` (with ``text``) and the chunks of each text, null where it has no words: ``s1, s2, hashes, sizes, need, n,
    bits``; s1 and s2 stand for the word set (128 bits), n is its size, and each word sets one of 64 bits: two sets differ in
    at least as many words as bits."""
    place, names = df.columns.index("text"), [*df.columns, *(c.split()[0] for c in _CHUNKED.split(", "))]

    def run(batches):
        known: dict[str, list[tuple[int, int]]] = {}
        for b in batches:
            rows = []
            for t in b.column(place).to_pylist():
                w = words(t)
                if not w:
                    rows.append((None,) * 7)
                    continue
                got: dict[int, int] = {}
                for x in w:
                    c = known.get(x)
                    if c is None:
                        if len(known) > 200_000:
                            known.clear()
                        c = known[x] = chunks(x)
                    got.update(c)
                line = " ".join(w).encode("utf-8")
                need = least_shared([len(x.encode("utf-8")) + 1 for x in w], sum(got.values()))
                rows.append((xxhash.xxh64_intdigest(line, 1) - (1 << 63), xxhash.xxh64_intdigest(line, 2) - (1 << 63), list(got), list(got.values()), need, len(w), word_bits(w)))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([r[i] for r in rows], t) for i, t in enumerate(_CHUNK_KINDS))], names=names)

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{own}, {_CHUNKED}")


def word_bits(w: list[str]) -> int:
    bits = 0
    for x in w:
        bits |= 1 << (xxhash.xxh64_intdigest(x, 3) & 63)
    return bits - (1 << 64) if bits >> 63 else bits


def close_sets(a: DataFrame, b: DataFrame):
    """Join condition that holds for every pair of sets of the needed overlap: they differ in at most (n + n) * (1 - j) /
    (1 + j) words. Within the join it keeps the postings of chunks that a large group shares from becoming rows."""
    return F.bit_count(a["bits"].bitwiseXOR(b["bits"])) <= (a["n"] + b["n"]) * F.lit((1 - MIN_JACCARD) / (1 + MIN_JACCARD)) + F.lit(1e-9)


class Common:
    """Counts of the common chunks, as sorted arrays."""

    def __init__(self, chunks: np.ndarray, counts: np.ndarray):
        order = np.argsort(chunks)
        self.chunks, self.counts = chunks[order], counts[order]

    @classmethod
    def of(cls, df: DataFrame) -> "Common":
        got = df.select("chunk", "n").toArrow()
        return cls(got.column(0).to_numpy(), got.column(1).to_numpy())

    def __or__(self, other: "Common") -> "Common":
        new = ~np.isin(self.chunks, other.chunks)
        return Common(np.concatenate([self.chunks[new], other.chunks]), np.concatenate([self.counts[new], other.counts]))

    def of_chunks(self, chunks: np.ndarray) -> np.ndarray:
        """The count of each chunk; 0 if it is not common."""
        if not len(self.chunks):
            return np.zeros(len(chunks), np.int64)
        at = np.minimum(np.searchsorted(self.chunks, chunks), len(self.chunks) - 1)
        return np.where(self.chunks[at] == chunks, self.counts[at], 0)


def prefixes(rows: DataFrame, common: Common, sent: list | None = None) -> DataFrame:
    """``chunk, key, n, bits``: each record's chunks from rare to common until those left hold fewer bytes than it must
    share."""
    order = rows.sparkSession.sparkContext.broadcast(common)
    if sent is not None:
        sent.append(order)

    def run(batches):
        rank = order.value
        for b in batches:
            hashes = b.column(0).flatten().to_numpy()
            sizes = b.column(1).flatten().to_numpy()
            length = pa.compute.list_value_length(b.column(0)).to_numpy(zero_copy_only=False).astype(np.int64)
            owner, start = np.repeat(np.arange(b.num_rows), length), np.cumsum(length) - length
            at = np.lexsort((hashes, rank.of_chunks(hashes), owner))
            done = np.concatenate([[0], np.cumsum(sizes[at])])  # bytes up to each chunk, through all rows
            left = done[start + length][owner] - done[:-1]
            keep = left >= b.column(2).to_numpy()[owner]
            rows_of = pa.array(owner[keep])
            yield pa.RecordBatch.from_arrays([pa.array(hashes[at][keep]), *(c.take(rows_of) for c in b.columns[3:])], names=["chunk", "key", "n", "bits"])

    return rows.select("hashes", "sizes", "need", "key", "n", "bits").mapInArrow(run, "chunk long, key long, n int, bits long")


@dataclass
class Decisions:
    """``decided``: key, pos, id, match (the smallest id of the accepted records that a row repeats, null if none), accepted.
    The other tables are what ``History.append`` needs of the rows."""

    decided: DataFrame
    rows: DataFrame
    prefix: DataFrame
    asks: DataFrame


class History:
    """Tables of the accepted records, in the folder ``path``. ``key`` is a record's id."""

    def __init__(self, spark: SparkSession, path: str, about: dict, common: Common | None = None, forest: rp.Forest | None = None):
        self.spark, self.path, self.about, self.dim = spark, path, about, about["dim"]
        self.scratch = Scratch(spark, "history")
        self.forest = forest or pickle.loads(b64decode(files.read_text(spark, f"{path}/{about['forest']}")))
        self.common = common or Common.of(self.table("common"))
        self._sent: list = []  # broadcasts of the last decision
        self.rows = self.table("rows")
        if about["source"]:
            self.rows = _keyed(spark.read.parquet(about["source"])).unionByName(self.rows)

    def release(self) -> None:
        """Drops what was sent to the executors for decisions, once their tables are written. Plans, shuffles and broadcasts
        of a step are held until the driver collects its garbage, so this is done once a step."""
        while self._sent:
            self._sent.pop().destroy()
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def table(self, name: str) -> DataFrame:
        """All parts of a table in one scan."""
        parts = [f"{self.path}/{p}" for level in self.about["parts"][name] for p in level]
        return self.spark.read.schema(_TABLES[name]).parquet(*parts) if parts else self.spark.createDataFrame([], _TABLES[name])

    @classmethod
    def start(cls, records: DataFrame, *, path: str | None = None, source: str | None = None, dim: int = DIM) -> "History":
        """Index ``records`` (id, vector, text): the only pass over the whole history. ``path`` is the history's folder (by
        default one that ends with the session); ``source`` names a Parquet table that holds the same records and stays,
        so that they need not be copied. Rows with a null id are no records."""
        spark = records.sparkSession
        s = Scratch(spark, "history-start")
        path = path or s.path("history")
        rows = _keyed(records)
        count = rows.count()
        about = {"dim": dim, "source": source, "batches": 0, "stale": [], "forest": f"forest-{uuid.uuid4().hex[:12]}", "parts": {n: [[]] for n in _TABLES}}

        def put(name: str, df: DataFrame) -> DataFrame:
            part = f"{name}-{uuid.uuid4().hex[:12]}"
            df.select(*[c.split()[0] for c in _TABLES[name].split(", ")]).write.parquet(f"{path}/{part}")
            about["parts"][name] = [[], [part]]
            return spark.read.schema(_TABLES[name]).parquet(f"{path}/{part}")

        if source is None:
            rows = put("rows", rows)
        ch = s.table(with_chunks(rows.select("key", "text")).where("n > 0").drop("text"), "chunks")
        df = ch.select(F.explode("hashes").alias("chunk")).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))
        bar = max(COMMON_ROWS, count // MOST_COMMON)
        common = Common.of(put("common", df.where(F.col("n") > bar)))
        sets, firsts = first_of_sets(ch, s)
        put("texts", sets)
        put("chunk_table", prefixes(firsts, common))
        good = rp.usable(rows, "key", "vector", dim)
        prints = good.select(F.col("id").alias("key"), *rp.fingerprint())
        one = s.table(prints.groupBy("h1", "h2").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("n")), "vectors")
        put("vectors", one)
        forest = rp.learn(good, count, dim, trees=TREES)
        # copies beyond the first of their vector stay out of the leaves
        shared = one.where("n > 1")
        many = shared.count()
        if many:
            twice = good.select("id", "vector", *rp.fingerprint()).join(broadcast_if(shared.select("h1", "h2", "key"), many, rp.SMALL), ["h1", "h2"], "left")
            good = twice.where("key IS NULL OR key = id").select("id", "vector")
        leaves = rp.route(good, forest, dim, member=True, query=False, probes=0, coarse=True)
        put("leaves", leaves.repartitionByRange("leaf", "id").sortWithinPartitions("leaf"))
        files.write_text(spark, f"{path}/{about['forest']}", b64encode(pickle.dumps(forest)).decode())
        files.write_text(spark, f"{path}/manifest.json", json.dumps(about))
        s.sweep()
        history = cls(spark, path, about, common, forest)
        history.release()
        return history

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "History":
        """A history that this or another session has written: no record is read."""
        return cls(spark, path, json.loads(files.read_text(spark, f"{path}/manifest.json")))

    # ------------------------------------------------------------------------------------------------------------
    def decide(self, incoming: DataFrame) -> "Decisions":
        """Decides each row of ``incoming`` (key, pos, id, text, vector), taken in the order of ``pos``.

        ``incoming`` may hold one batch or many. Rows equal in word set or vector are handled as one class, so a row
        sent a million times costs a million rows, never their pairs. Null ids, texts without words and vectors that are
        null, empty, zero, of another length or not finite repeat nothing by that field; a row whose id is null is
        never repeated by a later one. Other columns are ignored, whatever their names.
        """
        s = self.scratch
        v = F.when(rp.is_usable(F.col("vector"), self.dim), F.col("vector"))
        given = incoming.select("key", "pos", "id", "text", F.col("vector").cast("array<float>").alias("vector")).withColumn("vector", v)
        prints = [F.when(F.col("vector").isNotNull(), h).alias(n) for h, n in zip(rp.fingerprint(), ("h1", "h2"))]
        rows, n = s.counted(with_chunks(given.select("*", *prints)), "features")
        # classes: the first row of each word set and of each vector stands for all
        for key, name in ((["s1", "s2"], "tcls"), (["h1", "h2"], "vcls")):
            first = rows.where(F.col(key[0]).isNotNull()).groupBy(*key).agg(F.min("key").alias(name))
            rows = rows.join(broadcast_if(first, n, rp.SMALL), key, "left")
        rows = s.table(rows, "rows")
        texts, prefix = self._text_links(rows, n)
        vectors, asks = self._vector_links(rows, n)
        ids = self._fetch(rows.where("id IS NOT NULL").select(F.col("id").alias("key")), "id")
        links = texts.unionByName(vectors).unionByName(ids.select(F.lit("i").alias("kind"), F.col("key").alias("cls"), F.col("id").alias("other"), F.lit(True).alias("old")))
        return Decisions(s.table(self._resolve(rows, s.table(links, "links"), n), "decided"), rows, prefix, asks)

    def _fetch(self, keys: DataFrame, *columns: str) -> DataFrame:
        """``key`` and ``columns`` of the accepted rows with one of ``keys``. Up to rp.SMALL keys reach the scan as ranges,
        which skip files and pages of other keys; no old row is shuffled then."""
        return self._some(self.rows.select("key", *columns), keys)

    def _some(self, table: DataFrame, keys: DataFrame) -> DataFrame:
        keys = keys.distinct()
        got = keys.limit(rp.SMALL + 1).toArrow().column(0).to_numpy()
        if len(got) > rp.SMALL:
            return table.join(keys, "key", "left_semi")
        if not len(got):
            return table.limit(0)
        return table.where(in_ranges("key", got)).join(F.broadcast(keys), "key", "left_semi")

    def _text_links(self, rows: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
        """Links ``kind, cls, other, old`` of the word sets: to accepted keys and among themselves. Also their prefixes."""
        s = self.scratch
        reps = rows.where("tcls = key")
        mine = broadcast_if(reps.select("s1", "s2", F.col("key").alias("cls")), n, rp.SMALL)
        same = self.table("texts").select("s1", "s2", F.col("key").alias("other")).join(mine, ["s1", "s2"]).select("cls", "other", F.lit(True).alias("old"))
        # among the rows themselves, chunks that are common here are put last as well
        here = reps.select(F.explode("hashes").alias("chunk")).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))
        common = self.common | Common.of(here.where(F.col("n") > max(COMMON_ROWS, n // MOST_COMMON)))
        prefix = prefixes(reps, self.common, self._sent).withColumn("own", F.lit(False)).unionByName(prefixes(reps, common, self._sent).withColumn("own", F.lit(True)))
        prefix, m = s.counted(prefix, "prefixes")
        x, table = prefix.where("NOT own"), self.table("chunk_table")
        x = broadcast_if(x, m, rp.SMALL)
        cand = table.join(x, (x["chunk"] == table["chunk"]) & close_sets(x, table)).select(x["key"].alias("cls"), table["key"].alias("other"), F.lit(True).alias("old"))
        x, y = (self.spark.read.schema(prefix.schema).parquet(prefix._scratch_path).where("own") for _ in range(2))
        y = broadcast_if(y, m, rp.SMALL)
        own = x.join(y, (x["chunk"] == y["chunk"]) & (x["key"] < y["key"]) & close_sets(x, y)).select(x["key"].alias("cls"), y["key"].alias("other"), F.lit(False).alias("old"))
        cand = s.table(cand.unionByName(own).distinct(), "text-candidates")
        # shared byte totals and word sets need the texts of both sides; only candidates are fetched
        theirs = self._fetch(cand.where("old").select(F.col("other").alias("key")), "text").withColumn("old", F.lit(True))
        theirs = theirs.unionByName(reps.select("key", "text", F.lit(False).alias("old"))).select(F.col("key").alias("other"), "old", F.col("text").alias("t2"))
        my_text = broadcast_if(reps.select(F.col("key").alias("cls"), F.col("text").alias("t1")), n, SMALL_TEXTS)
        near = shared_enough(cand.join(theirs, ["other", "old"]).join(my_text, "cls").select("cls", "other", "old", "t1", "t2"))
        return same.unionByName(near).select(F.lit("t").alias("kind"), "cls", "other", "old"), prefix

    def _vector_links(self, rows: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
        """The same for vectors: equal fingerprints, and leaves probed with 8-bit codes, checked exactly. Also the leaves."""
        s = self.scratch
        reps = rows.where("vcls = key")
        mine = broadcast_if(reps.select("h1", "h2", F.col("key").alias("cls")), n, rp.SMALL)
        same = self.table("vectors").withColumnRenamed("key", "other").join(mine, ["h1", "h2"]).select("cls", "other", F.lit(True).alias("old"))
        asks, m = s.counted(rp.route(reps.select(F.col("key").alias("id"), "vector"), self.forest, self.dim, member=True, query=True, probes=PROBES, coarse=True, sent=self._sent), "asks")
        near = close_pairs(asks, self.dim, MIN_COS - COARSE).select("id", "other", F.lit(False).alias("old"))
        blocks, leaves = ask_blocks(asks, m), self.table("leaves")
        if len(blocks) > MOST_BLOCKS:
            searches = leaves.unionByName(asks.withColumn("role", F.lit(2).cast("byte")))
            near = near.unionByName(close_pairs(searches, self.dim, MIN_COS - COARSE).select("id", "other", F.lit(True).alias("old")))
        else:
            for block in blocks:
                near = near.unionByName(probe_leaves(leaves, block, self.dim, MIN_COS - COARSE, self._sent).select("id", "other", F.lit(True).alias("old")))
        pairs = s.table(near.where("old OR id != other").distinct(), "vector-candidates")
        theirs = self._fetch(pairs.where("old").select(F.col("other").alias("key")), "vector").withColumn("old", F.lit(True))
        theirs = theirs.unionByName(reps.select("key", "vector", F.lit(False).alias("old"))).select(F.col("key").alias("other"), "old", F.col("vector").alias("y"))
        x = broadcast_if(reps.select("vector", F.col("key").alias("id")), n, SMALL_TEXTS).withColumnRenamed("vector", "x")
        near = exact_pairs(pairs.join(theirs, ["other", "old"]).join(x, "id").select("id", "other", "old", "x", "y"), self.dim)
        return same.unionByName(near.select(F.col("id").alias("cls"), "other", "old")).select(F.lit("v").alias("kind"), "cls", "other", "old"), asks

    def _resolve(self, rows: DataFrame, links: DataFrame, n: int) -> DataFrame:
        """Decides rows in order: a row is a case if an accepted row before it is in a linked class, accepted once no row
        before it in a linked class is accepted or undecided. A few rounds settle all rows, as chains are short; each
        round handles only what is undecided and is aggregated by class, never by pair."""
        s = self.scratch
        kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("cls")) for k, c in (("i", "id"), ("t", "tcls"), ("v", "vcls"))])
        row_class = rows.select("key", F.explode(kinds).alias("e")).select("key", "e.kind", "e.cls").where("cls IS NOT NULL")
        new = links.where("NOT old").select("kind", "cls", F.col("other").alias("cls2"))
        reach = new.unionByName(new.select("kind", F.col("cls2").alias("cls"), F.col("cls").alias("cls2")))
        reach = reach.unionByName(row_class.select("kind", "cls", F.col("cls").alias("cls2")).distinct())
        small = lambda df: broadcast_if(df, n, rp.SMALL)
        old = links.where("old").groupBy("kind", "cls").agg(F.min("other").alias("old_id"))
        of_old = row_class.join(small(old), ["kind", "cls"]).groupBy("key").agg(F.min("old_id").alias("old_id"))
        state = rows.select("key", "pos", "id").join(small(of_old), "key", "left").withColumn("state", F.when(F.col("old_id").isNotNull(), "case").otherwise("open"))
        state = s.table(state, "state")
        while True:
            standing = state.where("state != 'case' AND id IS NOT NULL").select("key", "pos", "state")
            cls = row_class.join(small(standing), "key").groupBy("kind", F.col("cls").alias("cls2")).agg(
                F.min("pos").alias("any"), F.min(F.when(F.col("state") == "accepted", F.col("pos"))).alias("acc"))
            seen = reach.join(small(cls), ["kind", "cls2"]).groupBy("kind", "cls").agg(F.min("any").alias("any"), F.min("acc").alias("acc"))
            view = row_class.join(small(state.where("state = 'open'").select("key")), "key").join(small(seen), ["kind", "cls"]).groupBy("key").agg(
                F.min("any").alias("any"), F.min("acc").alias("acc"))
            new = state.join(small(view), "key", "left").withColumn(
                "state", F.when(F.col("state") != "open", F.col("state")).when(F.col("acc") < F.col("pos"), "case")
                .when(F.col("any").isNull() | (F.col("any") >= F.col("pos")), "accepted").otherwise("open"))
            before = state
            state, left = s.counted(new.select("key", "pos", "id", "old_id", "state"), "state", "state = 'open'")
            s.drop(before)
            if not left:
                break
        # smallest id of the accepted rows before a case: at most one accepted row stands in a class of texts or vectors,
        # and rows accepted with one id are one class
        acc = row_class.join(small(state.where("state = 'accepted' AND id IS NOT NULL").select("key", "pos", "id")), "key").groupBy(
            "kind", F.col("cls").alias("cls2")).agg(F.min(F.struct("pos", "id")).alias("first"))
        hit = row_class.join(small(state.where("state = 'case'").select("key", "pos")), "key").join(reach, ["kind", "cls"]).join(small(acc), ["kind", "cls2"]).where(
            F.col("first.pos") < F.col("pos")).groupBy("key").agg(F.min("first.id").alias("new_id"))
        out = state.join(small(hit), "key", "left")
        return out.select("key", "pos", "id", F.least("old_id", "new_id").alias("match"), (F.col("state") == "accepted").alias("accepted"))

    def append(self, d: "Decisions") -> "History":
        """Adds the accepted rows that have an id: a part with their chunks, one with their fingerprints, one with their
        leaves, as made for the decision. Common chunks and the forest stay as they were learned, so old entries remain
        valid. Returns the history with these rows; handles opened before see the state that they opened."""
        spark = self.spark
        about = json.loads(json.dumps(self.about))
        ok, n = d.decided.where("accepted AND id IS NOT NULL").select("key"), d.decided.count()
        new = d.rows.drop("hashes", "sizes", "need").join(broadcast_if(ok, n, rp.SMALL), "key", "left_semi")
        self._part(about, "rows", new.select(F.col("id").alias("key"), "id", "text", "vector"))
        self._part(about, "texts", new.where("n > 0").select(F.col("id").alias("key"), "s1", "s2"))
        self._part(about, "vectors", new.where("h1 IS NOT NULL").select(F.col("id").alias("key"), "h1", "h2"))
        of = lambda cls: broadcast_if(new.select(F.col("id").alias("key"), F.col(cls).alias("cls")), n, rp.SMALL)
        self._part(about, "chunk_table", d.prefix.where("NOT own").withColumnRenamed("key", "cls").join(of("tcls"), "cls"))
        leaves = d.asks.where("role = 3").withColumnRenamed("id", "cls").join(of("vcls"), "cls")
        self._part(about, "leaves", leaves.select("leaf", F.lit(1).cast("byte").alias("role"), F.col("key").alias("id"), "vector"))
        about["batches"] += 1
        gone = []
        for name, levels in about["parts"].items():
            for i in range(len(levels)):
                if len(levels[i]) >= MERGE:
                    gone += levels[i]
                    merged = spark.read.schema(_TABLES[name]).parquet(*[f"{self.path}/{p}" for p in levels[i]])
                    levels[i] = []
                    if i + 1 == len(levels):
                        levels.append([])
                    self._part(about, name, merged, i + 1)
        stale = about["stale"] if gone else []
        about["stale"] = gone or about["stale"]
        files.write_text(spark, f"{self.path}/manifest.json", json.dumps(about))
        for part in stale:  # parts merged now stay until the next merge, for those who read them
            files.remove(spark, f"{self.path}/{part}")
        new = History(spark, self.path, about, self.common, self.forest)
        new._sent, self._sent = self._sent, []
        return new

    def _part(self, about: dict, name: str, df: DataFrame, level: int = 0) -> DataFrame:
        part = f"{name}-{uuid.uuid4().hex[:12]}"
        df.select(*[c.split()[0] for c in _TABLES[name].split(", ")]).write.parquet(f"{self.path}/{part}")
        about["parts"][name][level].append(part)
        return self.spark.read.schema(_TABLES[name]).parquet(f"{self.path}/{part}")


def _keyed(records: DataFrame) -> DataFrame:
    return records.select(F.col("id").cast("long").alias("key"), F.col("id").cast("long").alias("id"), "text", F.col("vector").cast("array<float>").alias("vector")).where("id IS NOT NULL")


def in_ranges(key: str, values: np.ndarray, most: int = RANGES):
    """Condition that ``key`` lies in one of at most ``most`` ranges that hold all ``values`` (not empty), cut at the widest
    gaps."""
    v = np.unique(values)
    cuts = np.sort(np.argsort(np.diff(v.astype(np.float64)), kind="stable")[::-1][: most - 1]) + 1
    out = None
    for part in np.split(v, cuts):
        one = F.col(key).between(int(part[0]), int(part[-1]))
        out = one if out is None else out | one
    return out


def first_of_sets(ch: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Of ``chunk_rows``: ``key, s1, s2`` of the smallest key of each word set, and the rows of these keys. Only signatures
    are shuffled; the rows of repeated sets are dropped by their keys."""
    sets = ch.groupBy("s1", "s2").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("m"))
    sets = scratch.table(sets.select("key", "s1", "s2", "m"), "sets")
    twice = sets.where("m > 1")
    n = twice.count()
    if n:
        twice = broadcast_if(twice.select(F.col("key").alias("first"), "s1", "s2"), n, rp.SMALL)
        ch = ch.join(twice, ["s1", "s2"], "left").where("first IS NULL OR first = key").drop("first")
    return sets.drop("m"), ch


def shared_enough(pairs: DataFrame, least: float = MIN_JACCARD) -> DataFrame:
    """``cls, other, old`` of the pairs (with texts ``t1, t2``) whose shared chunks hold the bytes that both sides must
    share, and whose word sets then share at least ``least`` of their union."""

    def run(batches):
        known: dict[str, tuple[set[str], dict[int, int], int]] = {}

        def parts(text):
            got = known.get(text)
            if got is None:
                if len(known) > 5000:
                    known.clear()
                w, c = words(text), {}
                for x in w:
                    c.update(chunks(x))
                got = known[text] = (set(w), c, least_shared([len(x.encode("utf-8")) + 1 for x in w], sum(c.values()), least) if w else 1)
            return got

        for b in batches:
            keep = []
            for x, y in zip(b.column(3).to_pylist(), b.column(4).to_pylist()):
                (p, c1, n1), (q, c2, n2) = parts(x), parts(y)
                fine = sum(n for h, n in c1.items() if h in c2) >= max(n1, n2)
                both = len(p & q) if fine else 0
                keep.append(bool(both) and both >= least * (len(p) + len(q) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays(b.columns[:3], names=["cls", "other", "old"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "cls long, other long, old boolean")


def _close(asks: np.ndarray, members: np.ndarray, at: float):
    """Pairs of rows (search, member) that are at least ``at`` similar, block by block."""
    for i in range(0, len(asks), 256):
        for j in range(0, len(members), 16384):
            r, c = np.nonzero(asks[i : i + 256] @ members[j : j + 16384].T >= at)
            yield r + i, c + j


def close_pairs(routed: DataFrame, dim: int, at: float) -> DataFrame:
    """``id, other``: each search with every member of its leaf at least ``at`` similar, by 8-bit codes."""

    def run(table: pa.Table) -> pa.Table:
        role, ids = table.column("role").to_numpy(), table.column("id").to_numpy()
        u = rp.unit(rp.matrix(table.column("vector"), dim).astype(np.float32))
        members, asks = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
        found = [(asks[r], members[c]) for r, c in _close(u[asks], u[members], at)]
        cat = lambda x: ids[np.concatenate(x)] if x else np.zeros(0, np.int64)
        return pa.table({"id": cat([a for a, _ in found]), "other": cat([b for _, b in found])})

    return routed.groupBy("leaf").applyInArrow(run, "id long, other long")


def ask_blocks(asks: DataFrame, n: int) -> list[DataFrame]:
    """``n`` searches in blocks of at most about rp.SMALL rows (10 MB)."""
    blocks = max(1, -(-n // rp.SMALL))
    return [asks.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b) for b in range(blocks)] if blocks > 1 else [asks]


def probe_leaves(leaves: DataFrame, asks: DataFrame, dim: int, at: float, sent: list) -> DataFrame:
    """The same for one block of searches against the stored leaves, which are not shuffled: the block is broadcast, and
    as the table is sorted by leaf, row groups of leaves that nobody asks for are skipped."""
    got = asks.select("leaf", "id", "vector").toArrow()
    leaf, ids = got.column("leaf").to_numpy(), got.column("id").to_numpy()
    order = np.argsort(leaf, kind="stable")
    probed, start = np.unique(leaf[order], return_index=True)
    codes = rp.matrix(got.column("vector"), dim)[order] if len(leaf) else np.zeros((0, dim), np.int8)
    shared = leaves.sparkSession.sparkContext.broadcast((probed, np.append(start, len(leaf)), ids[order], codes))
    sent.append(shared)

    def run(batches):
        probed, start, ids, codes = shared.value
        for b in batches:
            here = b.column(0).to_numpy()
            member, m = b.column(1).to_numpy(), rp.matrix(b.column(2), dim).astype(np.float32)
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for x in np.unique(here):
                k = np.searchsorted(probed, x)
                if k < len(probed) and probed[k] == x:
                    rows, span = np.flatnonzero(here == x), slice(start[k], start[k + 1])
                    for r, c in _close(rp.unit(codes[span].astype(np.float32)), rp.unit(m[rows]), at):
                        left.append(ids[span][r])
                        right.append(member[rows[c]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["id", "other"])

    wanted = leaves.where(F.col("leaf").isin([int(x) for x in probed])) if len(probed) < 1000 else leaves
    return wanted.select("leaf", "id", "vector").mapInArrow(run, "id long, other long")


def exact_pairs(pairs: DataFrame, dim: int, at: float = MIN_COS) -> DataFrame:
    """``id, other, old`` of the pairs with a cosine (double precision, 6 decimals) of at least ``at``."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                cos = rp.exact_cosines(rp.matrix(b.column(3), dim), rp.matrix(b.column(4), dim))
                yield pa.RecordBatch.from_arrays(b.columns[:3], names=["id", "other", "old"]).filter(pa.array(np.rint(cos * 1e6) >= round(at * 1e6)))

    return pairs.mapInArrow(run, "id long, other long, old boolean")


def dedup_batches(history: History, incoming: DataFrame, *, step_rows: int = STEP_ROWS) -> DataFrame:
    """Decisions on all rows of ``incoming`` (recv_id, batch_no, id, vector, text) in the order of batch_no and recv_id. Each
    step is decided against the history, which then takes up its accepted rows. A step is a batch, or several that follow
    each other and have up to ``step_rows`` rows together: one decision on them gives the same rows as one each. A null
    batch_no comes first."""
    s = Scratch(incoming.sparkSession, "batches")
    path = s.path("incoming")
    ordered = in_order(incoming).withColumn("batch", F.col("pos.batch_no"))
    ordered.write.partitionBy("batch").parquet(path)
    rows = incoming.sparkSession.read.schema(ordered.schema).parquet(path)
    steps, held = [], 0
    for r in rows.groupBy("batch").count().orderBy(F.col("batch").asc_nulls_first()).collect():  # a row a batch
        if not steps or held + r["count"] > step_rows:
            steps.append([])
            held = 0
        steps[-1].append(r["batch"])
        held += r["count"]
    done = []
    for step in steps:
        named = [b for b in step if b is not None]
        here = F.col("batch").between(named[0], named[-1]) if named else F.lit(False)
        d = history.decide(rows.where(here | F.col("batch").isNull() if None in step else here).drop("batch"))
        done.append(d.decided._scratch_path)
        after = history.append(d)
        history.scratch.sweep(d.decided)
        history = after
        history.release()
    kind = "key long, pos struct<batch_no:long,recv_id:long>, id long, match long, accepted boolean"
    return incoming.sparkSession.read.schema(kind).parquet(*done) if done else incoming.sparkSession.createDataFrame([], kind)


def in_order(incoming: DataFrame) -> DataFrame:
    """Rows with their place (batch_no, recv_id); a row sent twice under one recv_id counts once."""
    rows = incoming.select(
        F.col("recv_id").cast("long").alias("key"), F.struct(F.col("batch_no").cast("long").alias("batch_no"), F.col("recv_id").cast("long").alias("recv_id")).alias("pos"), F.col("id").cast("long").alias("id"),
        "text", F.col("vector").cast("array<float>").alias("vector"))
    return rows.where("key IS NOT NULL").dropDuplicates(["key"])


def p1_found(spark, sf_dir: str) -> DataFrame:
    source = f"{sf_dir}/records.parquet"
    history = History.start(spark.read.parquet(source), source=source)
    decided = dedup_batches(history, spark.read.parquet(f"{sf_dir}/incoming.parquet"))
    return decided.where("NOT accepted").select(F.col("match").alias("id"), F.col("key").alias("recv_id"))


#: Row after row, against all pairs. SQL has no NFKC: of compatibility characters only full-width ones are folded.
_WIDE, _NARROW = ("".join(chr(at + i) for i in range(94) if chr(0x21 + i) != "'") for at in (0xFF01, 0x21))
P1_SQL = r"""
WITH RECURSIVE
w AS (SELECT 0 AS n, id AS k, id, vector, coalesce(text, '') AS text FROM records UNION ALL
  SELECT row_number() OVER (ORDER BY batch_no, recv_id), recv_id, id, vector, coalesce(text, '') FROM incoming),
x AS (SELECT n, k, id, list_distinct(regexp_extract_all(lower(nfc_normalize(translate(text, 'WIDE', 'NARROW'))), '[\p{L}\p{Nd}]+')) AS t,
    list_transform(range(1, 97), lambda j: CASE WHEN isfinite(vector[j]) THEN vector[j]::DOUBLE ELSE 0 END) AS v,
    coalesce(len(vector) = 96 AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(vector, lambda x: abs(x))) > 0, false) AS ok FROM w),
r AS (SELECT * FROM x WHERE n = 0),
i AS (SELECT n, k AS recv_id, id, t, v, ok FROM x WHERE n > 0),
hit AS (
  SELECT i.n, min(r.id) AS old FROM i, r
  WHERE i.id = r.id OR (i.ok AND r.ok AND round(list_cosine_similarity(i.v, r.v), 6) >= 0.985)
    OR (len(i.t) > 0 AND len(r.t) > 0 AND len(list_intersect(i.t, r.t)) >= 0.8 * (len(i.t) + len(r.t) - len(list_intersect(i.t, r.t))) - 1e-9)
  GROUP BY i.n),
pair AS (
  SELECT a.n, list(b.n) AS before FROM i a, i b
  WHERE b.n < a.n AND b.id IS NOT NULL AND (a.id = b.id OR (a.ok AND b.ok AND round(list_cosine_similarity(a.v, b.v), 6) >= 0.985)
    OR (len(a.t) > 0 AND len(b.t) > 0 AND len(list_intersect(a.t, b.t)) >= 0.8 * (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) - 1e-9))
  GROUP BY a.n),
j AS (SELECT i.n, i.recv_id, i.id, hit.old, coalesce(pair.before, []) AS before FROM i LEFT JOIN hit ON hit.n = i.n LEFT JOIN pair ON pair.n = i.n),
s AS (
  SELECT 0::BIGINT AS n, []::BIGINT[] AS accepted, []::BIGINT[] AS seen
  UNION ALL
  SELECT j.n, CASE WHEN j.old IS NULL AND len(list_intersect(j.before, s.accepted)) = 0 AND j.id IS NOT NULL THEN list_append(s.accepted, j.n) ELSE s.accepted END,
    list_intersect(j.before, s.accepted)
  FROM s JOIN j ON j.n = s.n + 1)
SELECT least(j.old, min(b.id)) AS id, j.recv_id FROM j JOIN s ON s.n = j.n LEFT JOIN j b ON list_contains(s.seen, b.n)
WHERE j.old IS NOT NULL OR len(s.seen) > 0 GROUP BY j.recv_id, j.old
""".replace("WIDE", _WIDE).replace("NARROW", _NARROW)

QUERIES = {"p1_found": p1_found}
SQL = {"p1_found": P1_SQL}
