"""Row types and configuration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

RECORD = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("vector", T.ArrayType(T.FloatType(), False), False),
    T.StructField("text", T.StringType(), False),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType(), False), False),
])

#: Largest id; ids are unsigned elsewhere, Spark's are signed.
MAX_ID = 2**63 - 1

FLOAT32, SCALAR8 = "f32", "int8"


@dataclass(frozen=True)
class GraphParams:
    """Bounds of the approximate index: links a node, candidates while building, candidates while searching."""

    max_neighbors: int = 16
    ef_construction: int = 64
    ef_search: int = 64


@dataclass(frozen=True)
class IndexKind:
    """``exact``, or ``graph`` with its parameters."""

    name: str = "exact"
    params: GraphParams | None = None

    def label(self) -> str:
        p = self.params
        return "exact" if p is None else f"graph(M={p.max_neighbors}, ef_construction={p.ef_construction}, ef_search={p.ef_search})"


EXACT = IndexKind()


def graph_index(params: GraphParams | None = None) -> IndexKind:
    return IndexKind("graph", params or GraphParams())


def encoding_label(encoding: str) -> str:
    return "float32" if encoding == FLOAT32 else "int8 (scalar-quantized)"
