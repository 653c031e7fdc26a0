"""Small files by the cluster's own file systems, so that paths mean the same on the driver and the executors."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A whole small file, such as a template or a header."""
    rows = spark.read.format("binaryFile").load(path).select("content").head(1)
    if not rows:
        raise FileNotFoundError(path)
    return bytes(rows[0].content)


def write_parts(spark: SparkSession, path: str, parts: Iterable[bytes]) -> None:
    """Write a file part by part, over one that is there."""
    at, system = _path(spark, path)
    out = system.create(at, True)
    try:
        for part in parts:
            out.write(bytearray(part))
    finally:
        out.close()
