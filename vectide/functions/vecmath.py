"""Vector arithmetic in single precision, as expressions that stay in the JVM.

Sums run in component order with every step rounded to a 32-bit float. Spark divides and takes roots in double
precision; casting back gives the correctly rounded 32-bit result, so scores are the same bits as a plain float loop.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _zero() -> Column:
    return F.lit(0).cast("float")


def vector_literal(values: Sequence[float]) -> Column:
    """A query vector as a constant array of 32-bit floats."""
    return F.lit([float(x) for x in values]).cast("array<float>") if len(values) else F.array().cast("array<float>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), _zero(), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, _zero(), lambda s, x: s + x * x)).cast("float")


def cosine(a: Column, b: Column, norm_b: Column | None = None) -> Column:
    """Cosine of two arrays of equal length; 0 if either norm is 0. ``norm_b`` may give a norm known beforehand."""
    n = norm(a) * (norm(b) if norm_b is None else norm_b)
    return F.coalesce(F.try_divide(dot(a, b).cast("double"), n.cast("double")).cast("float"), _zero())


def rank_key(score: Column) -> Column:
    """Sort key of a score: NaN ranks below everything."""
    return F.when(F.isnan(score), F.lit(float("-inf")).cast("float")).otherwise(score)


def norm_of(values: Sequence[float]) -> np.float32:
    """The norm that ``norm`` gives, for a vector held by the driver."""
    total = np.float32(0)
    with np.errstate(over="ignore", under="ignore"):
        for x in np.asarray(values, np.float32):
            total = np.float32(total + x * x)
        return np.float32(np.sqrt(np.float64(total)))


def cosines(rows: np.ndarray, query: np.ndarray, row_norms: np.ndarray | None = None) -> np.ndarray:
    """``cosine`` of every row with one query: components one after another, all rows at a time."""
    with np.errstate(all="ignore"):
        total = np.zeros(len(rows), np.float32)
        cols = np.ascontiguousarray(rows.T, dtype=np.float32)
        for c, q in zip(cols, np.asarray(query, np.float32)):
            total += c * q
        n = (row_norms if row_norms is not None else norms(rows)) * norm_of(query)
        out = np.zeros(len(rows), np.float32)
        np.divide(total.astype(np.float64), n.astype(np.float64), out=out, where=n != 0, casting="unsafe")
    return out


def norms(rows: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        total = np.zeros(len(rows), np.float32)
        for c in np.ascontiguousarray(rows.T, dtype=np.float32):
            total += c * c
        return np.sqrt(total.astype(np.float64)).astype(np.float32)


def bounds(vector: Column) -> tuple[Column, Column]:
    """Aggregates for the least and greatest component of a table; 0 if there is none."""
    return (F.coalesce(F.min(F.array_min(vector)), _zero()).alias("qmin"), F.coalesce(F.max(F.array_max(vector)), _zero()).alias("qmax"))


def quantize(vector: Column, low: Column, high: Column) -> Column:
    """Components as codes 0..255 (array<smallint>): half away from zero, clamped; all 0 without a span."""
    span = high - low

    def code(x: Column) -> Column:
        share = F.try_divide((x - low).cast("double"), span.cast("double")).cast("float")
        scaled = (share * F.lit(255).cast("float")).cast("double")
        c = F.least(F.greatest(F.floor(scaled + 0.5), F.lit(0)), F.lit(255))
        return F.when(span <= 0, F.lit(0)).otherwise(c).cast("smallint")

    return F.transform(vector, code)


def dequantize(codes: Column, low: Column, high: Column) -> Column:
    return F.transform(codes, lambda c: low + (c.cast("double") / F.lit(255.0)).cast("float") * (high - low))
