"""Helpers the operators of this folder share: bytes of texts, hashes, shared files, components."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from tablesync.session import scratch_path

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package's sources to the executors, once per application.

    The functions that run there are found by name, and an executor may have been started without
    the package on its path.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="run-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def text_column(df: DataFrame, name: str = "text") -> Column:
    """The text as a string, empty where it is null."""
    return F.coalesce(df[name].cast("string"), F.lit(""))


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sequence_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive values."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = mix(h[:n])
    for i in range(1, k):
        out = out * MULTIPLIER + h[i : n + i]
    return mix(out)


def signed(a: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's signed long."""
    return a.view(np.int64)


def give_back() -> None:
    """Returns memory that is free to the system: a Python worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


# Spark then removes a query's shuffle files when the query ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, what a query shuffled goes as soon as the query ends."""
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Written below the shared folder and read again, so that lost executors cost no recomputation.

    What was shuffled for it is of no use afterwards, so its files go as soon as it is written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_rows(columns: dict[str, np.ndarray | pa.Array], schema: pa.Schema, step: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``step`` rows."""
    table = pa.Table.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
    yield from table.to_batches(max_chunksize=step)


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest node each node reaches: columns ``node``, ``component``; nodes without an edge are absent.

    ``edges`` has the long columns ``a`` and ``b``. Stars shrink onto their smallest neighbour in
    alternating large and small steps until a round changes nothing; each round is checkpointed to
    the shared folder. A node's neighbours are never gathered: a step is a grouped minimum and a
    join, and the small step keeps one edge per node besides the new ones.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    current = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    seen = None
    while True:
        # large step: neighbours above a node go to its smallest neighbour (itself included)
        wide = both(current)
        least = wide.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = wide.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        # small step: neighbours at or below a node go to the smallest of them
        low = large.distinct()
        floor = low.groupBy("a").agg(F.min("b").alias("m"))
        small = low.join(floor, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        current = stored(small.union(floor.select("a", F.col("m").alias("b"))).distinct(), "cc")
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        seen = tuple(state)
