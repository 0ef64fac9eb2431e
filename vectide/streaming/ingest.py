"""Continuous upserts: each micro-batch is one atomic save of the collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from vectide.collection import Collection
from vectide.functions.validate import vector_fault


def upsert_stream(stream: DataFrame, path: str, *, checkpoint: str, rejected: str | None = None) -> DataStreamWriter:
    """A writer that upserts each micro-batch into the collection saved at ``path``.

    Of rows that share an id within a micro-batch the one with the greatest ``version`` stays (any, if there is no such
    column). A stream can't be refused, so rows with a faulty vector or id go to the Parquet table ``rejected`` (by default
    beside the collection), with the reason ``why`` and in a folder a micro-batch. A batch delivered twice leaves the same
    collection and the same rejected rows, so the sink is effectively exactly-once.
    """
    rejected = rejected or path.rstrip("/") + "-rejected"

    def apply(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            c = Collection.load(batch.sparkSession, path)
            bad_id = F.when(F.col("id").isNull() | (F.col("id") < 0), "id")
            judged = batch.withColumn("why", F.coalesce(bad_id, vector_fault(F.col("vector"), c.dimension)))
            bad = judged.where("why IS NOT NULL")
            if not bad.isEmpty():
                bad.write.mode("overwrite").parquet(f"{rejected}/epoch={epoch}")
            good = judged.where("why IS NULL")
            order = F.col("version") if "version" in good.columns else F.lit(0)
            rest = [x for x in ("vector", "text", "metadata") if x in good.columns]
            last = good.groupBy("id").agg(F.max_by(F.struct(*rest), order).alias("r")).select("id", "r.*")
            if not last.isEmpty():
                c.upsert(last)
                c.save(path)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
