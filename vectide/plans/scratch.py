"""Lineage cuts and broadcast decisions.

Intermediate tables go to the folder named by ``spark.checkpoint.dir``, which every executor of a cluster shares;
a lost executor therefore never loses one. Only where that setting is absent (a local session, as in tests) a
folder of our own is made.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_written: dict[str, SparkSession] = {}


@atexit.register
def _clear() -> None:
    """Tables of this process go when it ends: nothing reads them later."""
    for base, spark in _written.items():
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended before
            shutil.rmtree(base.removeprefix("file://"), ignore_errors=True)


def root(spark: SparkSession) -> str:
    """Shared scratch folder of the session."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/") + "/vectide"
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own[app] = tempfile.mkdtemp(prefix="vectide-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return "file://" + _own[app]


class Scratch:
    """Written tables of one operator call; ``drop`` removes those no longer needed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        self._tables: list[str] = []
        _written[self.base] = spark

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.base}/{self._n:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and return a scan of it; the scan remembers its folder for ``drop``."""
        path = self.path(name)
        df.write.parquet(path)
        self._tables.append(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def counted(self, df: DataFrame, name: str, where: str = "true") -> tuple[DataFrame, int]:
        """``table`` with the number of its rows for which ``where`` holds, counted while they are written."""
        seen = Observation()
        out = self.table(df.observe(seen, F.count_if(F.expr(where)).alias("n")), name)
        return out, seen.get["n"]

    def drop(self, *tables: DataFrame) -> None:
        self._delete([t._scratch_path for t in tables])

    def sweep(self, *keep: DataFrame) -> None:
        """Drops all tables written here so far but ``keep``."""
        kept = {t._scratch_path for t in keep}
        self._delete([p for p in self._tables if p not in kept])

    def _delete(self, paths: list[str]) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        self._tables = [p for p in self._tables if p not in set(paths)]


def broadcast_if(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Hint a broadcast only where the counted ``rows`` stay within ``most``; otherwise leave the join to a shuffle."""
    return F.broadcast(df) if rows <= most else df


def pack(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, so that operator columns can never clash with them."""
    return F.struct(*[df[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(df.columns)])


def unpack(struct: str, names: list[str]) -> list[Column]:
    return [F.col(f"{struct}.c{i}").alias(n) for i, n in enumerate(names)]
