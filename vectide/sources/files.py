"""Small files through Hadoop's file system, so that local, HDFS and object-store paths work alike."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession

from vectide.errors import StorageError


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    _, p, fs = _fs(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str:
    jvm, p, fs = _fs(spark, path)
    if not fs.exists(p):
        raise StorageError(f"no such file: {path}")
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str | Iterable[str]) -> None:
    """Written beside and renamed over the old file: a reader sees the old or the new one. Pieces are written as they come,
    in blocks of about a megabyte."""
    jvm, p, fs = _fs(spark, path)
    parent = p.getParent()
    if parent is not None:
        fs.mkdirs(parent)
    beside = jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    stream = fs.create(beside, True)
    try:
        block, held = [], 0
        for piece in [text] if isinstance(text, str) else text:
            block.append(piece)
            held += len(piece)
            if held > 1 << 20:
                stream.write(bytearray("".join(block).encode("utf-8")))
                block, held = [], 0
        stream.write(bytearray("".join(block).encode("utf-8")))
    finally:
        stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(beside, p, options)


def size(spark: SparkSession, path: str) -> int:
    _, p, fs = _fs(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def remove(spark: SparkSession, path: str) -> None:
    _, p, fs = _fs(spark, path)
    fs.delete(p, True)


def names(spark: SparkSession, path: str) -> list[str]:
    _, p, fs = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
