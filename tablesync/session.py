"""Session facts the operators rely on."""

from __future__ import annotations

import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows a DataFrame may have to be broadcast or collected: offsets, file lists, key lists.
SMALL_ROWS = 200_000


_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees, named by ``spark.checkpoint.dir``.

    Only a local session that names none gets a folder of its own.
    """
    global _local_dir
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        _local_dir = _local_dir or tempfile.mkdtemp(prefix="tablesync-")
        path = _local_dir
    return path.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tablesync/{label}-{uuid.uuid4().hex}"


def new_id() -> str:
    """Sortable by creation time, unique across writers."""
    return f"{int(time.time() * 1000):015d}-{uuid.uuid4().hex[:8]}"


def now_ms():
    return F.unix_millis(F.current_timestamp())


def local_frame(spark: SparkSession, rows, schema) -> DataFrame:
    """A few driver rows as a local relation.

    Spark knows its size, so joins with it need no shuffle, unlike a frame made of Python rows.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    columns = {f.name: pa.array([r[i] for r in rows]) for i, f in enumerate(schema)}
    return spark.createDataFrame(pa.table(columns), schema)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether anything lies at a path or pattern; asked of the file system, so no query fails for it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if "*" not in path:
        return files.exists(place)
    found = files.globStatus(place)
    return found is not None and len(found) > 0


def read_or_none(spark: SparkSession, path: str, schema=None, **options) -> DataFrame | None:
    """A parquet folder, or None when nothing was written there yet."""
    if not path_exists(spark, path):
        return None
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    try:
        return reader.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def is_small(df: DataFrame, limit: int = SMALL_ROWS) -> bool:
    return df.limit(limit + 1).count() <= limit


def broadcast_if_small(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """Broadcast behind a row count; beyond the limit Spark shuffles instead."""
    return F.broadcast(df) if is_small(df, limit) else df


# Files whose places may be broadcast: 16 bytes each. Spark's driver lists every file of a scan, so
# a scan has no more of them.
KEYED_FILES = 4_000_000


def join_by_file(rows: DataFrame, places: DataFrame) -> DataFrame:
    """``rows`` joined with ``places`` (one row per ``_file``) by the file they come from.

    Only a 64-bit key of the file's name and the other columns are broadcast, a few bytes per file;
    should two names ever have one key, files are joined by name.
    """
    others = [c for c in places.columns if c != "_file"]
    keyed = places.select("_file", F.xxhash64("_file").alias("_file_key"), *others)
    facts = keyed.agg(F.count("*").alias("n"), F.count_distinct("_file_key").alias("keys")).first()
    if facts["n"] > KEYED_FILES or facts["n"] != facts["keys"]:
        return rows.join(places, "_file")
    return rows.withColumn("_file_key", F.xxhash64("_file")).join(F.broadcast(keyed.drop("_file")), "_file_key").drop("_file_key")
