"""Byte-pair encoding of whole texts with a public rank file.

Merges run over a segment tree: its leaves are the byte positions of a piece, each holding the rank of the pair that
begins there, its root the leftmost pair of the smallest rank. A merge clears one leaf and rewrites the two leaves whose
pairs changed, each in logarithmic time, and links the live neighbours past the consumed position. A pasted log of a
megabyte without a space thus costs n log n. Texts are independent, so a corpus is one map without a shuffle.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Splits a text before merging; a fixed value of the public tokenizer.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces remembered by a Python worker; the memory is emptied when full, so its size is bounded.
REMEMBERED = 200_000
_NONE = 1 << 62


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken", folder: str = "/opt/tokenizers") -> str:
    return os.path.join(folder, name)


class BytePairEncoder:
    """Ids of texts by one rank file (``base64 rank`` a line). Special tokens do not exist here: their spellings are
    ordinary text. Null and empty texts have the empty list."""

    def __init__(self, path: str, pattern: str = PIECES):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return (whole,)
        n = len(piece)
        size = 1 << (n - 2).bit_length()  # leaves for the n - 1 pairs
        tree = [_NONE] * (2 * size)
        for i in range(n - 1):
            r = ranks.get(piece[i : i + 2])
            if r is not None:
                tree[size + i] = r * size + i  # ordered by rank, then position: the minimum is the leftmost
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after = list(range(1, n + 1))  # start of the next live part
        before = list(range(-1, n - 1))
        mask = size - 1

        def put(i: int, key: int) -> None:
            i += size
            tree[i] = key
            i >>= 1
            while i:
                a, b = tree[2 * i], tree[2 * i + 1]
                low = a if a < b else b
                if tree[i] == low:
                    return
                tree[i] = low
                i >>= 1

        get = ranks.get
        while (top := tree[1]) != _NONE:
            i = top & mask
            j = after[i]
            k = after[j]  # parts i..j and j..k become i..k
            after[i] = k
            if j < n - 1:
                put(j, _NONE)
            if k < n:
                before[k] = i
                r = get(piece[i : after[k]])
                put(i, _NONE if r is None else r * size + i)
            else:
                put(i, _NONE)
            h = before[i]
            if h >= 0:
                r = get(piece[h:k])
                put(h, _NONE if r is None else r * size + h)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        known, out = self.known, []
        for p in self.split(text):
            ids = known.get(p)
            if ids is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                ids = self.merge(p.encode("utf-8"))
                if len(p) < 64:
                    known[p] = ids
            out += ids
        return out


@lru_cache(maxsize=2)
def _encoder(path: str) -> BytePairEncoder:
    return BytePairEncoder(path)


def encode_texts(docs: DataFrame, text: str = "text", key: str = "doc_id", *, path: str | None = None, out: str = "ids") -> DataFrame:
    """``key, ids`` of every row, repeated rows and null keys included. ``path`` must be readable on every executor."""
    path = path or tokenizer_path()

    def run(batches):
        encoder = _encoder(path)
        for b in batches:
            # a few texts at a time: the ids of an Arrow batch of very long texts never pile up
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                lists = [encoder.encode(t) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
                flat = np.fromiter((x for ids in lists for x in ids), dtype=np.int32, count=int(ends[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[key, out])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key], docs[text]).mapInArrow(run, f"`{key}` {kind}, `{out}` array<int>")


def count_tokens(docs: DataFrame, text: str = "text", key: str = "doc_id", *, path: str | None = None, out: str = "n_tokens") -> DataFrame:
    """``key, n_tokens`` of every row; the ids themselves stay in the Python worker."""
    path = path or tokenizer_path()

    def run(batches):
        encoder = _encoder(path)
        for b in batches:
            counts = [len(encoder.encode(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], names=[key, out])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key], docs[text]).mapInArrow(run, f"`{key}` {kind}, `{out}` long")


def p7_ids(spark, sf_dir: str) -> DataFrame:
    return encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"p7_ids": p7_ids}
SQL: dict[str, str] = {}
