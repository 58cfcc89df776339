"""Tables that are replaced as a whole: written aside, then put in place by renames, so that a failed job leaves what was there."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _beside(path: str, kind: str) -> str:
    """A hidden name next to path: listings of its folder skip it."""
    folder, _, name = path.rstrip("/").rpartition("/")
    return f"{folder}/.{name}.{kind}" if folder or path.startswith("/") else f".{name}.{kind}"


def current(spark: SparkSession, path: str) -> str:
    """Where the table at path is to be read: there, or beside it if a replacement was cut off between its two renames."""
    old = _beside(path, "old")
    return old if not exists(spark, path) and exists(spark, old) else path


def replace(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """write(folder) writes the new table; only when that is done does it take the place of the one at path.

    A failure of the job removes what it wrote and raises; the old table stays. Readers that go through `current` see the
    old or the new table at any moment, never a part. On file systems without renames of folders (object stores) the last
    step copies.
    """
    new, old = _beside(path, uuid.uuid4().hex), _beside(path, "old")
    fs, at = _fs(spark, path)
    aside, before = (_fs(spark, x)[1] for x in (new, old))
    try:
        write(new)
    except Exception:
        fs.delete(aside, True)
        raise
    if fs.exists(at):
        fs.delete(before, True)
        fs.rename(at, before)
    if not fs.rename(aside, at):
        raise OSError(f"{path} couldn't be put in place; the old table is at {old}, the new one at {new}")
    fs.delete(before, True)
