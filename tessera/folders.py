"""Work folders on shared storage, and cut lineage."""

from __future__ import annotations

import atexit
import functools
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


#: Folders made inside of `cleaned`, by its thread.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


@functools.cache
def _own() -> str:
    """This process's temporary folder, gone when it ends."""
    folder = tempfile.mkdtemp(prefix="tessera-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def _path(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme; one without a scheme belongs to the default file system of the cluster."""
    if "://" in path:
        return path
    p, system = _path(spark, path)
    return re.sub(r"^file:/(?!/)", "file:///", system.makeQualified(p).toString())


def work_folder(spark: SparkSession, what: str) -> str:
    """A new folder's URI under spark.checkpoint.dir, which all machines share.

    Where that is unset, a temporary folder serves if the session runs on one machine (master local); on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = f"file://{_own()}"
    folder = f"{qualified(spark, base).rstrip('/')}/tessera-{what}-{uuid.uuid4().hex}"
    if (made := _MADE.get()) is not None:
        made.append(folder)
    return folder


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end and after an error too, the work folders that this thread made inside of it. Results are lazy, so write what is wanted before the end.

    An inner one deletes its own folders only. Folders that were never written are passed over.
    """
    made: list[str] = []
    outer = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(outer)
        for folder in made:
            remove(spark, folder)


def written(df: DataFrame, path: str) -> DataFrame:
    """The same rows read back from Parquet at path: lineage is cut and every executor can read them."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or pattern leads to anything."""
    p, system = _path(spark, path)
    found = system.globStatus(p)
    return found is not None and len(found) > 0


def remove(spark: SparkSession, folder: str) -> bool:
    """Deletes a work folder once nothing reads it any more; other folders are refused."""
    if not re.fullmatch(r"tessera-[\w-]+-[0-9a-f]{32}", folder.rstrip("/").rpartition("/")[2]):
        raise ValueError("not a work folder")
    p, system = _path(spark, folder)
    return system.delete(p, True)


def moved(spark: SparkSession, pattern: str, path: str) -> None:
    """Moves the one file that a pattern leads to; what is at the new path is replaced, folders on the way are made."""
    source, system = _path(spark, pattern)
    found = system.globStatus(source)
    if found is None or len(found) != 1:
        raise FileNotFoundError(f"not one file: {pattern}")
    target, _ = _path(spark, path)
    system.mkdirs(target.getParent())
    system.delete(target, False)
    if not system.rename(found[0].getPath(), target):
        raise OSError(f"can't move {pattern} to {path}")
