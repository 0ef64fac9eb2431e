"""Top N rows of every group by a hot-cold split.

Exact group counts divide the groups. Light groups go through an ordinary window. The rows of heavy groups get a
salt, are range-partitioned and sorted by (group, salt, order), keep N rows a salt, and only these survivors meet
in a window over the group. No task ever holds a whole heavy group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectide.plans.scratch import Scratch, pack, unpack

#: A group with more rows than this is heavy, unless that would make more than MOST_HEAVY groups heavy.
HEAVY_ROWS = 20_000
#: At most so many groups are heavy, whatever the input: the threshold is never below total rows / MOST_HEAVY.
MOST_HEAVY = 10_000
#: Rows that one salt of a heavy group should hold.
SALT_ROWS = 10_000


def top_n_per_group(
    df: DataFrame, group: Column, score: Column, ties: list[Column], n: int, *, salt_on: Column | None = None,
    heavy_rows: int = HEAVY_ROWS, salt_rows: int = SALT_ROWS, rank: str | None = None,
) -> DataFrame:
    """The ``n`` first rows of each group by ``score`` descending, then ``ties`` ascending.

    Defined cases: a null group is a group of its own; rows with null or NaN score are left out; -0.0 equals 0.0; null
    ties come first; rows equal in score and all ties are ranked by a hash of the whole row, so a run repeats its
    choice (rows equal in every column are interchangeable); ``n`` < 1 or an empty table gives no rows. The result has
    the columns of ``df`` (any names, duplicates aside) and, if ``rank`` is given, the 1-based rank.
    """
    spark, names = df.sparkSession, df.columns
    value = score.cast("double")
    keys = [f"t{i}" for i in range(len(ties))]
    rows = df.select(
        group.alias("g"), (value + F.lit(0.0)).alias("s"), *[t.alias(k) for t, k in zip(ties, keys)],
        pack(df).alias("row"),
    ).where(F.col("s").isNotNull() & ~F.isnan("s"))
    hashable = [f"row.c{i}" for i, f in enumerate(df.schema.fields) if "map" not in f.dataType.simpleString()]
    # rows with equal order get a fixed place by their content; maps cannot be hashed, their sorted entries can
    maps = [F.to_json(f"row.c{i}") for i, f in enumerate(df.schema.fields) if "map" in f.dataType.simpleString()]
    rows = rows.withColumn("h", F.xxhash64(*[F.col(c) for c in hashable], *maps))
    if n < 1:
        return _out(rows.limit(0).withColumn("k", F.lit(0)), names, rank)
    scratch = Scratch(spark, "topn")
    rows = scratch.table(rows, "rows")
    counts = rows.groupBy("g").agg(F.count(F.lit(1)).alias("m"))
    total = rows.count()
    bound = max(heavy_rows, total // MOST_HEAVY)
    # at most total / bound <= MOST_HEAVY groups pass, so this broadcast has a fixed bound
    heavy = F.broadcast(scratch.table(counts.where(F.col("m") > bound), "heavy"))
    order = [F.col("s").desc(), *[F.col(k).asc_nulls_first() for k in keys], F.col("h")]
    by_group = Window.partitionBy("g").orderBy(*order)

    light = rows.join(heavy, rows["g"].eqNullSafe(heavy["g"]), "left_anti").withColumn("k", F.row_number().over(by_group))
    big = rows.join(heavy.withColumnRenamed("g", "hg"), F.col("g").eqNullSafe(F.col("hg"))).drop("hg")
    salts = F.ceil(F.col("m") / F.lit(salt_rows))
    big = big.withColumn("salt", F.pmod(F.xxhash64(salt_on if salt_on is not None else F.col("h"), F.lit(17)), salts))
    by_salt = Window.partitionBy("g", "salt").orderBy(*order)
    big = big.repartitionByRange("g", "salt").withColumn("k", F.row_number().over(by_salt)).where(F.col("k") <= n)
    big = big.drop("salt", "m").withColumn("k", F.row_number().over(by_group))
    return _out(light.unionByName(big).where(F.col("k") <= n), names, rank)


def _out(rows: DataFrame, names: list[str], rank: str | None) -> DataFrame:
    return rows.select(*unpack("row", names), *([F.col("k").alias(rank)] if rank else []))


def first_of_repeats(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows equal in ``keys`` (nulls equal each other) the one with the smallest ``order``; combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.col(order)).alias("b")
    return df.groupBy(*keys).agg(best).select(*[F.col(k) if k in keys else F.col(f"b.{k}") for k in df.columns])


def p2_found(spark, sf_dir: str) -> DataFrame:
    hits = spark.read.parquet(f"{sf_dir}/search_results.parquet")
    hits = hits.select("result_id", "query_id", "id", "score", F.col("metadata")["thread"].alias("thread")).where(
        (F.col("thread") != "") & F.col("score").isNotNull() & ~F.isnan("score")
    )
    hits = first_of_repeats(hits, ["query_id", "id"], "result_id")
    top = top_n_per_group(hits, F.col("thread"), F.col("score"), [F.col("id"), F.col("result_id")], 10)
    return top.select("thread", "result_id")


P2_SQL = """
WITH f AS (
  SELECT metadata['thread'] AS thread, result_id, query_id, id, score + 0.0 AS score FROM search_results
  WHERE coalesce(metadata['thread'], '') <> '' AND score IS NOT NULL AND NOT isnan(score)),
d AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY result_id) AS n FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY thread ORDER BY score DESC, id, result_id) AS k FROM d WHERE n = 1)
SELECT thread, result_id FROM r WHERE k <= 10
"""

QUERIES = {"p2_found": p2_found}
SQL = {"p2_found": P2_SQL}
