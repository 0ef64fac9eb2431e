"""Texts decoded with the wrong encoding: found and, where possible, restored.

Learning. Texts are cut into passages (lines and sentences). Passages equal once their non-ASCII characters are stripped
are near-twins; the version held by the most documents is taken for the clean one. Where a twin differs, both are
aligned on their ASCII characters, and each pair of differing runs votes for the transformations (bytes written in one
encoding, read in another) that explain it. A greedy cover keeps the few transformations that explain the votes.

Applying. Every text is searched with the learned transformations. If bytes of UTF-8 were read in a one-byte encoding,
a run of non-ASCII characters that turns back into valid UTF-8 shows it by itself. If one-byte text was read in another
encoding, or as UTF-8 with losses, a word is judged by the corpus: the word it turns into must be a common clean form of
the same ASCII letters. Word counts, like passages, are aggregated over all documents before they are compared.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.plans.scratch import Scratch

#: Encodings that texts may have been written in and read in: those of files and pages in practice.
ENCODINGS = ("utf-8", "cp1252", "latin-1", "cp1251", "mac_roman", "cp850", "cp437", "cp1250", "iso8859-2", "koi8-r", "cp866")
#: Different passages that must vote for a transformation.
SUPPORT = 3
#: A clean form must be in so many times the documents of the garbled one.
RATIO = 3
LOST = "�"
#: Bits of the table of suspect words that every task gets (128 KB); it only saves rows of a join.
SUSPECT_BITS = 1 << 20

_RUN = re.compile(r"[^\x00-\x7f]+")
_PASSAGE = re.compile(r"[\r\n]+|(?<=[.!?:;])\s+")
_CAPITALS = re.compile("[A-Z]{2}")
_LETTER = re.compile("[A-Za-z]")
_WORD = re.compile(r"[A-Za-z\x80-\U0010ffff]+")


def _table(read: str) -> dict[int, str]:
    """Character of each byte; bytes the encoding leaves open become control characters, as lenient decoders do."""
    out = {}
    for b in range(256):
        try:
            out[b] = bytes([b]).decode(read)
        except UnicodeDecodeError:
            out[b] = chr(b)
    return out


_READ = {e: _table(e) for e in ENCODINGS if e != "utf-8"}
_BYTE = {e: {c: b for b, c in t.items() if b > 127} for e, t in _READ.items()}


def garble(text: str, written: str, read: str) -> str | None:
    """What ``text`` looks like after the wrong decoding; None if ``written`` lacks a character."""
    try:
        raw = text.encode(written)
    except UnicodeEncodeError:
        return None
    return raw.decode("utf-8", "replace") if read == "utf-8" else "".join(map(_READ[read].__getitem__, raw))


def as_bytes(run: str, read: str) -> bytes | None:
    """The bytes of a run of non-ASCII characters as ``read`` would have given them."""
    back = _BYTE[read]
    try:
        return bytes([back[c] for c in run])
    except KeyError:
        return None


_SCRIPTS = regex.compile(r"[\p{L}\p{M}\p{N}\p{P}\p{S}\p{Zs}­​-‏﻿]+")


def undo_utf8(run: str, read: str, familiar: frozenset[str]) -> str | None:
    """The original of a whole run of characters that were UTF-8 read in ``read``, or None if it can't be that.

    All of the run must be valid UTF-8. One single decoded character must be familiar, as two characters may form a
    valid sequence by chance; several decoded characters prove themselves, if they are not unassigned or private."""
    raw = as_bytes(run, read)
    if raw is None:
        return None
    try:
        out = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    if not _SCRIPTS.fullmatch(out):
        return None
    if len(out) == 1 or read in ("cp1251", "koi8-r", "cp866"):
        return out if all(c in familiar for c in out) else None
    return out


def undo_run(run: str, reads: list[str], familiar: frozenset[str]) -> tuple[str, int]:
    """The run restored through as many layers as were applied (at most three), and how many there were. A run that is
    garbled only in part is taken apart at its first and last characters."""
    best, layers = run, 0
    while layers < 3:
        for read in reads:
            out = undo_utf8(best, read, familiar)
            if out is not None:
                best, layers = out, layers + 1
                break
        else:
            break
        if best.isascii() or not _RUN.fullmatch(best):
            break
    return best, layers


def _parts(run: str, reads: list[str], familiar: frozenset[str]) -> tuple[str, int]:
    """``undo_run``, or else over the longest stretches of the run that can be undone; a stretch needs a lead byte that
    stands for its UTF-8 length, so clean neighbours of a garbled character stay as they are."""
    out, n = undo_run(run, reads, familiar)
    if n or len(run) < 3:
        return out, n
    pieces, i, total = [], 0, 0
    while i < len(run):
        for read in reads:
            b = _BYTE[read].get(run[i])
            size = 0 if b is None else 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
            if size and i + size <= len(run):
                got = undo_utf8(run[i : i + size], read, familiar)
                if got is not None and got in familiar:
                    pieces.append(got)
                    i += size
                    total += 1
                    break
        else:
            pieces.append(run[i])
            i += 1
    return ("".join(pieces), 1) if total else (run, 0)


def explains(garbled: str, clean: str, encodings=ENCODINGS) -> list[tuple[str, str]]:
    return [(w, r) for w in encodings for r in encodings if w != r and garble(clean, w, r) == garbled]


# ---------------------------------------------------------------------------------------------------------- learning


def counts(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``skeleton, passage, n`` of passages with non-ASCII characters (skeleton hashes their ASCII part) and ``word, n`` of
    words with such characters; ``n`` is the number of documents. Texts are read once for both."""
    kinds = (pa.bool_(), pa.int64(), pa.string(), pa.int64())

    def run(batches):
        for b in batches:
            whole: Counter = Counter()
            single: Counter = Counter()
            for t in b.column(0).to_pylist():
                if t and not t.isascii():
                    whole.update({p for p in _PASSAGE.split(t) if not p.isascii()})
                    single.update(words_of(t))
            rows = [(True, xxhash.xxh64_intdigest(a) - (1 << 63), p, n) for p, n in whole.items() if len(a := p.encode("ascii", "ignore")) >= 8]
            rows += [(False, 0, w, n) for w, n in single.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["whole", "skeleton", "piece", "n"])

    found = docs.select("text").mapInArrow(run, "whole boolean, skeleton long, piece string, n long")
    found = scratch.table(found.groupBy("whole", "skeleton", "piece").agg(F.sum("n").alias("n")), "counts")
    return found.where("whole").select("skeleton", F.col("piece").alias("passage"), "n"), found.where("NOT whole").select(F.col("piece").alias("word"), "n")


def _aligned(a: str, b: str):
    """Pairs of differing runs at the same place among the ASCII characters."""
    at = lambda s: {m.start() - k: m.group() for m, k in _with_offset(s)}
    x, y = at(a), at(b)
    for k in x.keys() & y.keys():
        if x[k] != y[k] and unicodedata.normalize("NFC", x[k]) != unicodedata.normalize("NFC", y[k]):
            yield x[k], y[k]


def _with_offset(s: str):
    taken = 0
    for m in _RUN.finditer(s):
        yield m, taken
        taken += m.end() - m.start()


def learn_transformations(p: DataFrame) -> list[tuple[str, str]]:
    """Transformations in the order of the votes they explain. Votes are aggregated by the set of transformations that
    would explain them, and only these few sums reach the driver."""
    clean = p.groupBy("skeleton").agg(F.count(F.lit(1)).alias("forms"), F.max_by("passage", F.struct("n", "passage")).alias("clean")).where("forms > 1")
    twins = p.join(clean, "skeleton").where("passage != clean").select("skeleton", "passage", "clean")

    def vote(batches):
        memory: dict[tuple[str, str], str] = {}
        for b in batches:
            rows = set()
            for s, g, c in zip(*(x.to_pylist() for x in b.columns)):
                for pair in _aligned(g, c):
                    if pair not in memory:
                        if len(memory) > 100_000:
                            memory.clear()
                        memory[pair] = ";".join(f"{w}>{r}" for w, r in explains(*pair))
                    if memory[pair]:
                        rows.add((s, memory[pair]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string()))], names=["skeleton", "by"])

    votes = twins.mapInArrow(vote, "skeleton long, by string").groupBy("by").agg(F.count_distinct("skeleton").alias("n"))
    left = {r["by"]: r["n"] for r in votes.collect()}  # sets of encoding pairs: bounded by the encodings, not by the texts
    learned = []
    while left:
        total: Counter = Counter()
        for by, n in left.items():
            for t in by.split(";"):
                total[t] += n
        order = {f"{w}>{r}": i for i, (w, r) in enumerate((w, r) for w in ENCODINGS for r in ENCODINGS)}
        top, n = min(total.items(), key=lambda x: (-x[1], order[x[0]]))
        if n < SUPPORT:
            break
        learned.append(tuple(top.split(">")))
        left = {by: n for by, n in left.items() if top not in by.split(";")}
    return learned


# ---------------------------------------------------------------------------------------------------------- applying


def words_of(text: str) -> set[str]:
    """Words that have a non-ASCII character."""
    return {w for w in _WORD.findall(text) if not w.isascii()}


def _familiar(words: DataFrame, least: int = 3) -> frozenset[str]:
    """Non-ASCII characters of words in at least ``least`` documents: at most the characters of Unicode."""
    chars = words.where(F.col("n") >= least).select(F.explode(F.array_distinct(F.split("word", ""))).alias("c"))
    return frozenset(r["c"] for r in chars.where(F.length("c") > 0).distinct().collect() if not r["c"].isascii() and not 0x80 <= ord(r["c"][0]) < 0xA0)


def _turned(one_byte: list[tuple[str, str]]):
    """For a word, what it would have been under each one-byte transformation, and its letters without lost ones."""
    back = []
    for w, r in one_byte:
        t = {}
        for b in range(128, 256):
            try:
                t[ord(_READ[r][b])] = bytes([b]).decode(w)
            except UnicodeDecodeError:
                continue
        back.append((f"{w}>{r}", t))

    def turn(word: str):
        for name, t in back:
            if all(c.isascii() or ord(c) in t for c in word):
                out = word.translate(t)
                if out != word and not out.isascii():
                    yield name, out

    return turn


def suspects(words: DataFrame, one_byte: list[tuple[str, str]], scratch: Scratch) -> DataFrame:
    """``word, clean``: words that turn into a much more common form by a learned one-byte transformation, and words with
    lost characters and the most common form of the same remaining letters (null if there is none)."""
    turn = _turned(one_byte)

    def run(batches):
        for b in batches:
            rows = [(w, n, out, name) for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if LOST not in w and (len(w) > 2 or _LETTER.search(w)) for name, out in turn(w)]
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["word", "n", "clean", "by"])

    turned = words.mapInArrow(run, "word string, n long, clean string, by string")
    known = words.select(F.col("word").alias("clean"), F.col("n").alias("m"))
    hits = turned.join(known, "clean").where(F.col("m") >= RATIO * F.col("n"))
    hits = hits.groupBy("word").agg(F.max_by(F.struct("clean", "by"), F.struct("m", "clean")).alias("b")).select("word", "b.clean", "b.by")
    shape = F.regexp_replace("word", r"[^\x00-\x7f]+", "*")
    lost = words.where(F.col("word").contains(LOST)).select("word", shape.alias("shape"))
    forms = words.where(~F.col("word").contains(LOST)).groupBy(shape.alias("shape")).agg(F.max_by("word", F.struct("n", "word")).alias("clean"))
    lost = lost.join(forms, "shape", "left").select("word", F.when(F.col("shape") != "*", F.col("clean")).alias("clean"), F.lit("lost").alias("by"))
    return scratch.table(hits.unionByName(lost), "suspects")


def find_garbled(docs: DataFrame, *, key: str = "doc_id", text: str = "text", restore: bool = False) -> DataFrame:
    """``key, layers, restored`` of each row whose text is garbled in whole or in part.

    ``layers`` is the most often that a run of it was decoded wrongly (1 for one-byte mix-ups and lost characters).
    ``restored`` is the text with all that could be regained put back, null unless ``restore``; characters lost without a
    clean twin stay lost. Null, empty and ASCII texts are no case; neither is correct text in any script, composed or
    decomposed. Rows are judged each by itself, repeated rows and null keys included.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mojibake")
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    passages, words = counts(rows, scratch)
    learned = learn_transformations(passages)
    reads = list(dict.fromkeys([r for w, r in learned if w == "utf-8"]))
    one_byte = [(w, r) for w, r in learned if w != "utf-8" and r != "utf-8"]
    bad = suspects(words, one_byte, scratch)
    shared = spark.sparkContext.broadcast((reads, _familiar(words), _bits(bad)))

    def by_itself(batches):
        reads, familiar, bits = shared.value
        memory: dict[str, tuple[str, int]] = {}
        doubtful: dict[str, bool] = {}

        def undone(run: str) -> tuple[str, int]:
            if run not in memory:
                if len(memory) > 100_000:
                    memory.clear()
                memory[run] = _parts(run, reads, familiar)
            return memory[run]

        def in_doubt(word: str) -> bool:
            if word not in doubtful:
                if len(doubtful) > 100_000:
                    doubtful.clear()
                at = _bit(word)
                doubtful[word] = bool(bits[at >> 3] >> (at & 7) & 1)
            return doubtful[word]

        for b in batches:
            keys, layers, texts, rest = [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                if not t or t.isascii():
                    continue
                most = 0
                if any(undone(r)[1] for r in set(_RUN.findall(t))):

                    def undo(m):
                        nonlocal most
                        out, n = undone(m.group())
                        # a capital and a closing mark ending a word in capitals, as in AMANHÃ», are no small letter
                        if n and len(out) == 1 and out.islower() and _CAPITALS.search(m.string, max(0, m.start() - 2), m.start()):
                            return m.group()
                        most = max(most, n)
                        return out

                    t = _RUN.sub(undo, t)
                w = [x for x in words_of(t) if in_doubt(x)] if restore or not most else []
                if most or w:
                    keys.append(i)
                    layers.append(most)
                    texts.append(t if restore else None)
                    rest.append(w)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(keys, pa.int64())), pa.array(layers, pa.int32()), pa.array(texts, pa.string()), pa.array(rest, pa.list_(pa.string()))],
                names=["key", "layers", "text", "words"])

    seen = rows.mapInArrow(by_itself, f"key {kind}, layers int, text string, words array<string>")
    seen = scratch.table(seen.withColumn("no", F.monotonically_increasing_id()), "seen")
    # only rows with words of a set bit are here; which of these are suspects is told by a join
    hit = seen.select("no", F.explode("words").alias("word")).join(bad, "word").groupBy("no").agg(
        F.map_from_entries(F.collect_set(F.struct("word", "clean"))).alias("swap"))
    both = seen.join(hit, "no", "left").where("layers > 0 OR swap IS NOT NULL")
    both = both.withColumn("layers", F.greatest("layers", F.lit(1)))
    if not restore:
        return both.select(F.col("key").alias(key), "layers", F.lit(None).cast("string").alias("restored"))

    def put_back(batches):
        for b in batches:
            out = []
            for t, swap in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                swap = dict(swap or [])
                out.append(_WORD.sub(lambda m: swap.get(m.group()) or m.group(), t))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=[key, "layers", "restored"])

    return both.select("key", "layers", "text", "swap").mapInArrow(put_back, f"`{key}` {kind}, layers int, restored string")


def _bit(word: str) -> int:
    return xxhash.xxh64_intdigest(word, 17) % SUSPECT_BITS


def _bits(bad: DataFrame) -> bytes:
    """A bit for each suspect word: combined in parallel, of one size whatever the number of words."""

    def run(batches):
        bits = np.zeros(SUSPECT_BITS, bool)
        for b in batches:
            bits[[_bit(w) for w in b.column(0).to_pylist()]] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(SUSPECT_BITS // 8, np.uint8)
    for r in bad.select("word").coalesce(16).mapInArrow(run, "bits binary").toLocalIterator():  # at most 16 rows
        out |= np.frombuffer(r["bits"], np.uint8)
    return out.tobytes()


def p9_found(spark, sf_dir: str) -> DataFrame:
    return find_garbled(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id")


def p9_restored(spark, sf_dir: str) -> DataFrame:
    return find_garbled(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), restore=True)


QUERIES = {"p9_found": p9_found, "p9_restored": p9_restored}
SQL: dict[str, str] = {}
