"""Checks of rows and queries. Row checks are expressions evaluated in one pass; the first offender by id is reported."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.errors import DimensionMismatch, InvalidId, InvalidVector

EMPTY, NOT_FINITE, WRONG_SIZE = "vector cannot be empty", "all values must be finite", "dimension"


def vector_fault(vector: Column, dimension: int | None) -> Column:
    """Null if the vector is fine, else the first reason against it: empty, not finite, wrong length."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fault = F.when(vector.isNull() | (F.size(vector) == 0), EMPTY).when(bad, NOT_FINITE)
    return fault if dimension is None else fault.when(F.size(vector) != dimension, WRONG_SIZE)


def check_rows(df: DataFrame, dimension: int | None) -> int | None:
    """Raises for the smallest id with a fault. Returns the dimension, inferred from the smallest id where unset."""
    first = df.agg(F.min_by(F.size("vector"), "id").alias("d"), F.count_if(F.col("id").isNull() | (F.col("id") < 0)).alias("ids")).first()
    if first["ids"]:
        raise InvalidId("ids must be 0 .. 2^63 - 1 and not null")
    dim = dimension if dimension is not None else (first["d"] if first["d"] and first["d"] > 0 else None)
    fault = vector_fault(F.col("vector"), dim)
    worst = df.where(fault.isNotNull()).agg(F.min_by(F.struct(fault.alias("why"), F.size("vector").alias("n")), "id").alias("w")).first()["w"]
    if worst is not None:
        raise_fault(worst["why"], dim, worst["n"])
    return dim


def raise_fault(why: str, dim: int | None, size: int) -> None:
    if why == WRONG_SIZE:
        raise DimensionMismatch(dim, size)
    raise InvalidVector(why)


def check_query(query: Sequence[float], dimension: int | None) -> list[float]:
    """A query must be non-empty and finite, and fit the dimension where one is known."""
    if query is None or len(query) == 0:
        raise InvalidVector(EMPTY)
    values = [float(x) for x in query]
    if not all(map(math.isfinite, values)):
        raise InvalidVector(NOT_FINITE)
    if dimension is not None and len(values) != dimension:
        raise DimensionMismatch(dimension, len(values))
    return values


def check_dimension(dimension: int | None) -> None:
    if dimension is not None and dimension < 1:
        raise InvalidVector("dimension must be greater than zero")
