"""Numbered commits of a folder: small files that appear once and never change.

A writer prepares its data where nobody looks, then creates the file of the next number, which names
that data. The file system refuses to create a file that exists, so of two writers that prepared
the same number one is told that it lost. (On a local disk this is a check just before the creation,
on HDFS it is atomic; an object store must support conditional writes.) An empty file, left by a
writer that died in between, is passed over.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class CommitConflict(RuntimeError):
    """Another writer committed first."""


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def committed(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the commits there are."""
    place, files = _place(spark, folder)
    if not files.exists(place):
        return []
    names = [s.getPath().getName() for s in files.listStatus(place) if s.getLen() > 0]
    return sorted(int(n) for n in names if n.isdigit())


def read_commit(spark: SparkSession, folder: str, number: int) -> str:
    place, files = _place(spark, f"{folder}/{number:020d}")
    stream = files.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def newest_commit(spark: SparkSession, folder: str) -> tuple[int, str | None]:
    """Number and content of the newest commit; 0 and None before the first."""
    numbers = committed(spark, folder)
    return (numbers[-1], read_commit(spark, folder, numbers[-1])) if numbers else (0, None)


def commit(spark: SparkSession, folder: str, number: int, content: str) -> None:
    """Create a commit; ``CommitConflict`` if its number is taken."""
    place, files = _place(spark, f"{folder}/{number:020d}")
    try:
        stream = files.create(place, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            raise CommitConflict(f"version {number} of {folder} is taken") from None
        raise
    try:
        stream.write(bytearray(content.encode()))
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder; False if there was none."""
    place, files = _place(spark, path)
    return files.delete(place, True)


def entries(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """Names in a folder and their modification times in milliseconds."""
    place, files = _place(spark, folder)
    if not files.exists(place):
        return []
    return [(s.getPath().getName(), s.getModificationTime()) for s in files.listStatus(place)]


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Move a file, making the target's folder."""
    place, files = _place(spark, target)
    files.mkdirs(place.getParent())
    if not files.rename(spark._jvm.org.apache.hadoop.fs.Path(source), place):
        raise OSError(f"cannot rename {source} to {target}")
