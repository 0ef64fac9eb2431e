"""Inserts, upserts and deletes on immutable tables: checked before a new state exists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.errors import DuplicateId, NotFound
from vectide.functions.validate import check_rows


def as_records(df: DataFrame) -> DataFrame:
    """Columns of a record, in order; text defaults to empty, metadata to none."""
    have = set(df.columns)
    text = F.coalesce(F.col("text"), F.lit("")) if "text" in have else F.lit("")
    meta = F.coalesce(F.col("metadata"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))) if "metadata" in have else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return df.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<float>").alias("vector"), text.alias("text"), meta.cast("map<string,string>").alias("metadata"))


def first_duplicate(existing: DataFrame, batch: DataFrame) -> int | None:
    """The smallest id that is in both tables or twice in the batch; only ids are shuffled."""
    twice = batch.groupBy("id").count().where("count > 1").select("id")
    both = batch.select("id").join(existing.select("id"), "id", "left_semi")
    return twice.unionByName(both).agg(F.min("id")).first()[0]


def insert(existing: DataFrame, batch: DataFrame, dimension: int | None) -> tuple[DataFrame, int | None]:
    """All rows of ``batch`` are new, or nothing changes. A duplicate id is reported before an invalid vector."""
    batch = as_records(batch)
    id = first_duplicate(existing, batch)
    if id is not None:
        raise DuplicateId(id)
    dimension = check_rows(batch, dimension)
    return existing.unionByName(batch), dimension


def upsert(existing: DataFrame, batch: DataFrame, dimension: int | None) -> tuple[DataFrame, int | None, bool]:
    """Rows of ``batch`` replace those of the same id whole. Also whether any was replaced. Of rows that repeat an id in
    the batch an error is raised, as their order is undefined."""
    batch = as_records(batch)
    twice = batch.groupBy("id").count().where("count > 1").agg(F.min("id")).first()[0]
    if twice is not None:
        raise DuplicateId(twice)
    dimension = check_rows(batch, dimension)
    replaced = not existing.join(batch.select("id"), "id", "left_semi").isEmpty()
    return existing.join(batch.select("id"), "id", "left_anti").unionByName(batch), dimension, replaced


def delete(existing: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What remains, and the removed records. An id that is not there raises ``NotFound`` and changes nothing."""
    ids = ids.select("id").distinct()
    gone = ids.join(existing.select("id"), "id", "left_anti").agg(F.min("id")).first()[0]
    if gone is not None:
        raise NotFound(gone)
    return existing.join(ids, "id", "left_anti"), existing.join(ids, "id", "left_semi")
