"""Paths of any store that Spark reaches."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.getFileStatus(p).isDirectory()


def finished(spark: SparkSession, path: str) -> bool:
    """True when a write to ``path`` has been committed."""
    return exists(spark, f"{path}/_SUCCESS")


def children(spark: SparkSession, path: str) -> list[str]:
    p, fs = _path(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def touch(spark: SparkSession, path: str) -> None:
    """An empty file."""
    p, fs = _path(spark, path)
    fs.create(p, True).close()


def remove(spark: SparkSession, path: str) -> None:
    """A file or folder with all it holds, if there is one."""
    p, fs = _path(spark, path)
    fs.delete(p, True)
