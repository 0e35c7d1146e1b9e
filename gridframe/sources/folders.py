"""Folders on any file system that Spark reaches: patterns, and writes that are there wholly or not at all."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import SparkSession


def hadoop(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """The file system of a path, and the path as it knows it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = hadoop(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    fs, at = hadoop(spark, path)
    fs.delete(at, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, at = hadoop(spark, new)
    if at.getParent() is not None:
        fs.mkdirs(at.getParent())
    if fs.exists(at) or not fs.rename(hadoop(spark, old)[1], at):
        raise FileExistsError(f"{new} is there already, or {old} can't be renamed")


def find(spark: SparkSession, patterns: str | list[str]) -> list[str]:
    """The paths that match a pattern or any of several, in the order of the patterns and then by name, each once.

    A pattern without a match is an error."""
    out: dict[str, None] = {}
    for pattern in [patterns] if isinstance(patterns, str) else patterns:
        fs, at = hadoop(spark, pattern)
        found = sorted(x.getPath().toString() for x in fs.globStatus(at) or [])
        if not found:
            raise FileNotFoundError(pattern)
        out.update(dict.fromkeys(found))
    return list(out)


@contextmanager
def committed(spark: SparkSession, path: str, overwrite: bool = False, preserve: bool = False) -> Iterator[str]:
    """A folder aside to write to; it becomes ``path`` when the block ends well.

    When the block fails, or the path is there by then, the folder is deleted (kept, with ``preserve``) and
    nothing is at the path that wasn't before.  Renaming is a file system's own step: one at once on
    HDFS and local disks, a copy on most object stores."""
    if not overwrite and exists(spark, path):
        raise FileExistsError(path)
    aside = f"{path.rstrip('/')}.partial-{uuid.uuid4().hex}"
    try:
        yield aside
        if overwrite and exists(spark, path):
            before = f"{path.rstrip('/')}.before-{uuid.uuid4().hex}"
            rename(spark, path, before)
            try:
                rename(spark, aside, path)
            except Exception:
                rename(spark, before, path)
                raise
            remove(spark, before)
        else:
            rename(spark, aside, path)
    except BaseException:
        if not preserve:
            remove(spark, aside)
        raise


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share; one of this machine only for a local session without ``spark.checkpoint.dir``."""
    known = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if known is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="spark-")
    return f"{known.rstrip('/')}/{uuid.uuid4().hex}"
