"""The k most similar vectors of every vector: dense groups compared whole, other rows by grids of leaves where a least
cosine is asked and by a random-projection forest where none is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectide.llm import forest as rp
from vectide.plans.scratch import Scratch, broadcast_if

DIM = 96
#: Each vector outside the dense groups is a member of its own leaf of every grid (or tree) and searches the PROBES first leaves
#: of all, so PROBES copies of it are shuffled at most, one for each task that has some of them; see the README for recall.
TREES, PROBES, LEAF_ROWS = 2, 8, 8192
#: The same for trees, where no least cosine is asked.
FOREST_TREES, FOREST_PROBES = 4, 5


def nearest(
    records: DataFrame, k: int = 10, min_cos: float = -1.0, *, id: str = "id", vector: str = "vector", dim: int = DIM,
    trees: int | None = None, probes: int | None = None, leaf_rows: int = LEAF_ROWS, queries=None,
) -> DataFrame:
    """``id, other, cosine, rank``: for every row (or those that the condition ``queries`` on ``id`` picks) its ``k`` most
    similar other rows with a cosine of at least ``min_cos``.

    Cosines are exact (double precision, rounded to 6 decimals); equal ones rank by smaller id. Which rows are compared
    is decided by leaves, so a neighbour may be missed, but none of a row well inside a dense group (``forest.Cells``); see the
    README for recall. Exact copies are found without
    fail: they are collapsed before the search and listed after it. Rows with a null id or a vector that is null, empty,
    of another length, not finite or zero have no neighbours and are none. Rows that repeat an id count once.
    """
    spark = records.sparkSession
    scratch = Scratch(spark, "nearest")
    rows = rp.usable(records, id, vector, dim)
    reps, copies, n_copies = rp.collapse(rows, scratch)
    count = reps.count()
    x = rp.sampled(reps, count, dim)
    cells = rp.fit_cells(x, count, min_cos) if count > leaf_rows else None  # up to that, all rows share a leaf
    whole = min_cos >= rp.CELL_COS
    trees, probes = trees or (TREES if whole else FOREST_TREES), probes or (PROBES if whole else FOREST_PROBES)
    if whole:
        forest = rp.grids(x, count, trees=trees, leaf_rows=leaf_rows, probes=probes, cells=cells)
    else:
        forest = rp.learn(reps, count, dim, trees=trees, leaf_rows=leaf_rows, x=x)
    if queries is None:
        routed = rp.route(reps, forest, dim, member=True, query=True, probes=probes, coarse=False, cells=cells)
    else:
        members = rp.route(reps, forest, dim, member=True, query=False, probes=probes, coarse=False, cells=cells)
        asked = reps.where(queries)
        if n_copies:  # a copy is searched for by its representative
            others = broadcast_if(copies.where(queries).select(F.col("rep").alias("id")).distinct(), n_copies, rp.SMALL)
            asked = asked.unionByName(reps.where(~queries).join(others, "id", "left_semi"))
        asks = rp.route(asked, forest, dim, member=False, query=True, probes=probes, coarse=False, cells=cells)
        routed = members.unionByName(asks)
    lists = rp.merge_lists(rp.search_leaves(routed, dim, k, min_cos, leaf_rows=leaf_rows, whole=whole, back=whole and queries is None), k)
    if n_copies:
        lists = _with_copies(scratch.table(lists, "lists"), copies, n_copies, k, scratch)
    if queries is not None:
        lists = lists.where(queries)
    pairs = lists.select("id", F.posexplode("near").alias("p", "e"))
    return pairs.select("id", F.col("e.b").alias("other"), (-F.col("e.c") / F.lit(1e6)).alias("cosine"), (F.col("p") + 1).alias("rank"))


def _with_copies(lists: DataFrame, copies: DataFrame, n: int, k: int, scratch: Scratch) -> DataFrame:
    """Lists of representatives made into lists of all rows. Of a set of copies only the k + 1 smallest ids can be in any
    list, so a set of any size is a short list of heads."""
    smallest = Window.partitionBy("rep").orderBy("id")
    heads = copies.withColumn("r", F.row_number().over(smallest)).where(F.col("r") <= k)
    heads = heads.groupBy("rep").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    heads = heads.select("rep", F.concat(F.array("rep"), "ids").alias("heads"))
    heads = broadcast_if(scratch.table(heads, "heads"), n, rp.SMALL)
    # only lists that name a set of copies change, and those of the sets themselves
    named = lists.select("id", F.explode("near.b").alias("rep")).join(heads.select("rep"), "rep", "left_semi").select("id")
    touched, m = scratch.counted(named.unionByName(heads.select(F.col("rep").alias("id"))).distinct(), "touched")
    touched = broadcast_if(touched, m, rp.SMALL)
    others = lists.join(touched, "id", "left_anti")
    # neighbours that stand for copies
    e = lists.join(touched, "id", "left_semi").select("id", F.explode("near").alias("e")).select("id", F.col("e.c").alias("c"), F.col("e.b").alias("rep"))
    e = e.join(heads, "rep", "left").withColumn("heads", F.coalesce("heads", F.array("rep")))
    e = e.select("id", F.explode("heads").alias("b"), "c")
    own = heads.select(F.col("rep").alias("id"), F.explode("heads").alias("b"), F.lit(-1_000_000).alias("c"))
    best = F.slice(F.array_sort(F.collect_list(F.struct("c", "b"))), 1, k + 1)
    of_rep = scratch.table(e.unionByName(own).groupBy("id").agg(best.alias("near")), "of-representatives")
    # every copy has its representative's list; the representative has its own
    twins = broadcast_if(copies.withColumnRenamed("id", "twin"), n, rp.SMALL)
    of_copy = of_rep.join(twins, of_rep["id"] == twins["rep"]).select(F.col("twin").alias("id"), "near")
    changed = of_rep.unionByName(of_copy)
    return changed.select("id", F.slice(F.filter("near", lambda x: x["b"] != F.col("id")), 1, k).alias("near")).unionByName(others)


def p4_found(spark, sf_dir: str) -> DataFrame:
    pairs = nearest(spark.read.parquet(f"{sf_dir}/records.parquet").select("id", "vector"), 10, 0.80)
    return pairs.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def p4_nearest(spark, sf_dir: str) -> DataFrame:
    """The ten nearest of every record whose id is divisible by 50, against all records and without a threshold. Without
    one, neighbours may be far and more leaves are searched: recall 0.984 on the large check tables."""
    records = spark.read.parquet(f"{sf_dir}/records.parquet").select("id", "vector")
    return nearest(records, 10, -1.0, queries=F.col("id") % 50 == 0, trees=2, probes=32)


#: Brute force over all pairs: exact, and so are our rows while all records share one leaf (up to LEAF_ROWS).
_PAIRS = """
WITH r AS (SELECT id, vector::DOUBLE[] AS v FROM records WHERE list_max(list_transform(vector, lambda x: abs(x))) > 0),
p AS (SELECT * FROM (SELECT a.id, b.id AS other, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM r a, r b WHERE a.id <> b.id{asked}) WHERE cosine >= {least}),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, other)::INTEGER AS rank FROM p)
"""

QUERIES = {"p4_found": p4_found, "p4_nearest": p4_nearest}
SQL = {
    "p4_found": _PAIRS.format(asked="", least=0.8) + "SELECT DISTINCT least(id, other) AS id_a, greatest(id, other) AS id_b FROM k WHERE rank <= 10",
    "p4_nearest": _PAIRS.format(asked=" AND a.id % 50 = 0", least=-1) + "SELECT id, other, cosine, rank FROM k WHERE rank <= 10",
}
