"""Continuous loading: newly committed chunks as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tablesync.functions.codec import checked_json
from tablesync.model import MANIFEST
from tablesync.operators.load import ChunkConflict
from tablesync.session import broadcast_if_small
from tablesync.sources.raw_store import RawStore
from tablesync.sources.staged import (
    Staging, check_manifest_bucket, foreign_columns, keep_adopted, number_lines, one_file_per_task,
    read_chunks, summarize_lines,
)


def read_stream_staged(
    spark: SparkSession, staging: Staging, max_attempts_per_batch: int | None = None
) -> DataFrame:
    """Stream of manifest rows: a chunk arrives when its attempt is committed."""
    layout = T.StructType([*MANIFEST.fields, T.StructField("run", T.StringType())])
    reader = spark.readStream.schema(layout)
    if max_attempts_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", max_attempts_per_batch)
    return reader.parquet(staging.manifests).drop("run")


def newest_attempts(chunks: DataFrame, replace: bool = False) -> DataFrame:
    """One manifest row per key, that of the newest attempt; older ones must agree in content
    unless ``replace``."""
    by_key = chunks.groupBy("object_key").agg(
        F.max("attempt").alias("_newest"), F.count_distinct("content_hash").alias("_contents")
    )
    if not replace:
        clash = by_key.filter("_contents > 1").select("object_key").take(1)
        if clash:
            raise ChunkConflict(f"chunk {clash[0]['object_key']} was staged twice with unlike content")
    joined = chunks.join(by_key, "object_key").filter(F.col("attempt").eqNullSafe(F.col("_newest")))
    return joined.select(*chunks.columns)


def stream_load(
    spark: SparkSession, staging: Staging, target: RawStore, checkpoint: str,
    continuous: str | None = None, replace: bool = False,
) -> StreamingQuery:
    """Load arriving chunks exactly once.

    The stream carries only manifest rows; each micro-batch reads its chunks like the batch
    loader. A replayed batch finds its keys applied and adds nothing, and a key staged more than
    once within a batch counts as its newest attempt. Without a ``continuous``
    interval the query loads what is there and stops.
    """

    def load(batch: DataFrame, _batch_id: int) -> None:
        check_manifest_bucket(batch, staging.bucket)
        newest = newest_attempts(batch, replace)
        target.load(newest, lambda chunks: read_chunks(spark, staging, chunks), replace)

    writer = (
        read_stream_staged(spark, staging).writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
    )
    trigger = {"processingTime": continuous} if continuous else {"availableNow": True}
    return writer.trigger(**trigger).start()


FOREIGN_KEYS = ("stream_name", "partition_key", "sequence")


def read_stream_foreign(spark: SparkSession, staging: Staging, max_files_per_batch: int | None = None) -> DataFrame:
    """Stream of the lines of chunks that other tools stage, one file per task.

    The file source keeps which files it has handed out, of any age, so the driver neither gathers
    paths nor compares listings. A folder without files yet is awaited.
    """
    reader = one_file_per_task(spark).readStream.format("text").options(
        pathGlobFilter="*.jsonl.gz", recursiveFileLookup=True, maxFileAge="36500d"
    )
    if max_files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_batch)
    return foreign_columns(reader.load(f"{staging.chunks}/streams"))


def stream_foreign_load(
    spark: SparkSession, staging: Staging, target: RawStore, checkpoint: str,
    continuous: str | None = None, replace: bool = False, max_files_per_batch: int | None = None,
) -> StreamingQuery:
    """Load chunks of the other layout as their files arrive, each digested once and loaded once.

    A micro-batch counts and digests its files, keeps the outcome where ``load_staging`` finds it, and
    loads the chunks whose keys are not applied. A batch that is repeated after a failure finds its
    keys applied; a key applied with other content is an error unless ``replace``. A file
    without lines brings nothing. Files are taken as complete when they appear and are not
    looked at again: chunks that are rewritten under their name need ``load_staging``.
    """

    def load(batch: DataFrame, _batch_id: int) -> None:
        counted = summarize_lines(batch.withColumn("_at", F.col("_modified")), *FOREIGN_KEYS, "_at")
        chunks = keep_adopted(counted.withColumnRenamed("_at", "created_at_unix_ms"), staging)
        if not chunks.take(1):
            return

        def read(todo: DataFrame) -> DataFrame:
            wanted = broadcast_if_small(todo.select(*FOREIGN_KEYS))
            numbered = number_lines(batch, FOREIGN_KEYS).join(wanted, list(FOREIGN_KEYS), "left_semi")
            return numbered.select(
                staging.key().alias("object_key"), *FOREIGN_KEYS, "_row_number", checked_json(F.col("value")).alias("value")
            )

        target.load(chunks, read, replace)

    writer = (
        read_stream_foreign(spark, staging, max_files_per_batch).writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
    )
    trigger = {"processingTime": continuous} if continuous else {"availableNow": True}
    return writer.trigger(**trigger).start()
