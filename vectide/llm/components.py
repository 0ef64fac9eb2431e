"""Connected components of a distributed graph by alternating large-star and small-star steps.

Neither step gathers a node's neighbours: minima are aggregated with map-side combining and joined back, so a node with
a third of all edges is as harmless as any. Each round is a written table; the rounds needed grow with the logarithm of
the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.plans.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """``a, label`` for each node of the edges ``a, b`` (long): label is the component's smallest node. Loops, repeated
    edges and nulls are allowed (nulls are dropped); an empty table gives no rows."""
    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = scratch.table(e, "edges")
    alone = edges.where("a = b").select("a")
    mark = _mark(e)
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a AND b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        new = scratch.table(small.select("e.a", "e.b").where("a != b").distinct(), "edges")
        scratch.drop(e)
        e, now = new, _mark(new)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("b").alias("a"), F.col("b").alias("label")).distinct()
    linked = e.select("a", F.col("b").alias("label")).unionByName(roots)
    return linked.unionByName(alone.distinct().join(linked.select("a"), "a", "left_anti").select("a", F.col("a").alias("label")))


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
