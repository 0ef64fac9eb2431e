from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vectide.errors import InvalidVector
from vectide.functions import vecmath as vm
from vectide.functions.text import parse_vector, parse_vector_column


def plain_cosine(a, b) -> np.float32:
    """One float after another."""
    f = np.float32
    d = n = m = f(0)
    with np.errstate(all="ignore"):
        for x, y in zip(np.asarray(a, f), np.asarray(b, f)):
            d, n, m = f(d + x * y), f(n + x * x), f(m + y * y)
        n, m = f(np.sqrt(n)), f(np.sqrt(m))
        return f(0) if n == 0 or m == 0 else f(d / f(n * m))


def test_generator_golden_values(vec):
    assert vec(0, 4) == pytest.approx([-0.13694406, -0.9471325, 0.9417639, -0.78730667], abs=1e-7)
    assert vec(1, 4) == pytest.approx([0.49156344, 0.9420054, -0.11128163, -0.1114707], abs=1e-7)
    assert vec((1 << 64) - 1, 2) == pytest.approx([0.82519436, -0.5610361], abs=1e-7)


def test_cosine_is_bit_equal_to_a_float_loop(spark, vec):
    rows = [(i, vec(i, 24), vec(i + 900, 24)) for i in range(200)]
    rows += [(900, [0.0] * 24, vec(3, 24)), (901, [1e-30] * 24, [1e-30] * 24), (902, vec(1, 24), vec(1, 24))]
    df = spark.createDataFrame(rows, "id int, a array<float>, b array<float>")
    got = {r["id"]: np.float32(r["s"]) for r in df.select("id", vm.cosine(F.col("a"), F.col("b")).alias("s")).collect()}
    for i, a, b in rows:
        assert got[i] == plain_cosine(a, b), i
        assert vm.cosines(np.array([a], np.float32), b)[0] == got[i], i
    assert got[900] == 0 and got[901] == 0 and got[902] == pytest.approx(1, abs=1e-6)


def test_overflow_gives_nan_that_ranks_last(spark):
    df = spark.createDataFrame([(1, [1e30, 1e30]), (2, [-1.0, 0.0])], "id int, v array<float>")
    q = [1e30, 1e30]
    s = df.select("id", vm.cosine(F.col("v"), vm.vector_literal(q), F.lit(float(vm.norm_of(q))).cast("float")).alias("s"))
    assert np.isnan(s.where("id = 1").first()["s"])
    assert [r["id"] for r in s.orderBy(vm.rank_key(F.col("s")).desc(), "id").collect()] == [2, 1]


@pytest.mark.parametrize("rows", [[[0.1, 0.9, 0.5], [0.8, 0.2, 0.0]], [[3.0, 3.0], [3.0, 3.0]], [[-1e10, 1e10], [0.0, 5.0]]])
def test_quantization_round_trip(spark, rows):
    df = spark.createDataFrame([(r,) for r in rows], "v array<float>")
    low, high = df.agg(*vm.bounds(F.col("v"))).first()
    lo, hi = F.lit(low).cast("float"), F.lit(high).cast("float")
    coded = df.withColumn("c", vm.quantize(F.col("v"), lo, hi)).withColumn("b", vm.dequantize(F.col("c"), lo, hi))
    for r in coded.collect():
        assert all(0 <= c <= 255 for c in r["c"])
        assert np.allclose(r["v"], r["b"], atol=(high - low) / 510 * 1.001 + 1e-6)


def test_bounds_of_nothing(spark):
    empty = spark.createDataFrame([], "v array<float>")
    assert tuple(empty.agg(*vm.bounds(F.col("v"))).first()) == (0.0, 0.0)


def test_crc32_check_value(spark):
    assert spark.range(1).select(F.crc32(F.lit("123456789").cast("binary")).alias("c")).first()["c"] == 0xCBF43926


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(width=32, allow_nan=False, allow_infinity=False)), st.sampled_from([", ", " ", ",", "\n\t", " , "]))
def test_parse_vector_round_trip(values, sep):
    assert parse_vector("[" + sep.join(repr(v) for v in values) + "]") == values


def test_parse_vector_errors_and_column(spark):
    with pytest.raises(InvalidVector):
        parse_vector("1, x")
    assert parse_vector(" [1 2,3] ") == [1, 2, 3] and parse_vector("") == []
    df = spark.createDataFrame([("[1, 2.5]",), ("1 x",), ("",)], "s string")
    assert [r[0] for r in df.select(parse_vector_column(F.col("s"))).collect()] == [[1.0, 2.5], [1.0, None], []]
