"""Staged chunks: gzipped JSON lines on any Hadoop file system, plus their manifest.

Layout of a staging area (``file:``, ``hdfs:`` and ``s3a:`` alike)::

    <root>/<bucket>[/<prefix>]/pipelines/<pipeline>/attempt=<A>/
        stream_name=<S>/partition_key=<K>/sequence=<N>/digest=<D>/part-*.txt.gz
    <root>/<bucket>[/<prefix>]/manifests/<pipeline>/run=<R>/part-*.parquet

Every table of every run is written to a fresh ``attempt`` folder (two jobs may not share an
output folder) and counts only once the run's manifest is there, so a job that dies half-way
leaves files nobody reads. Chunks staged by other tools under
``pipelines/<P>/streams/<S>/partitions/<K>/chunks/<20 digits>.jsonl.gz`` can be read too.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.functions.codec import checked_json, content_digest, not_blank, record_column, strip
from tablesync.functions.names import chunk_key
from tablesync.model import (
    CONTENT_ENCODING, CONTENT_TYPE, DEFAULT_PARTITION, MANIFEST, select_as,
)
from tablesync.operators.chunking import ROW, file_offsets
from tablesync.operators.sizing import line_bytes
from tablesync.session import (
    broadcast_if_small, join_by_file, local_frame, new_id, now_ms, path_exists, read_or_none, scratch_path,
)
from tablesync.sources.commits import delete, entries

CHUNK_COLUMNS = ("attempt", "stream_name", "partition_key", "sequence")
_LINE_KEYS = "attempt string, stream_name string, partition_key string, sequence bigint"
_OWN_SCHEMA = f"value string, {_LINE_KEYS}, digest string"
# Stands in the folder's name where a chunk's digest was not known when it was written; a chunk of very many
# files has more such folders, with numbers behind it.
UNKNOWN = "unknown"
# Files of one such folder, and folders of one scan: Spark's driver holds a kilobyte or two per file and task of a scan.
FOLDER_FILES, SCAN_FOLDERS = 256, 64
SCAN_FILES = FOLDER_FILES * SCAN_FOLDERS


@dataclass(frozen=True)
class Staging:
    """Where a pipeline's chunks live."""

    root: str
    pipeline: str
    bucket: str = "staging"
    prefix: str = ""

    @property
    def base(self) -> str:
        parts = [self.root.rstrip("/"), self.bucket, self.prefix.strip().strip("/")]
        return "/".join(p for p in parts if p)

    @property
    def chunks(self) -> str:
        return f"{self.base}/pipelines/{self.pipeline}"

    @property
    def adopted(self) -> str:
        return f"{self.base}/adopted/{self.pipeline}"

    @property
    def manifests(self) -> str:
        return f"{self.base}/manifests/{self.pipeline}"

    def attempt(self, attempt: str) -> str:
        return f"{self.chunks}/attempt={attempt}"

    def key(self, stream="stream_name", partition="partition_key", sequence="sequence") -> Column:
        return chunk_key(
            self.pipeline, F.col(stream), F.col(sequence), F.col(partition), self.prefix
        )


# ---------------------------------------------------------------- writing

# Tasks that write a table's chunks; beyond that, each writes several, one after the other.
MOST_WRITERS = 20_000
# Rows a task writes at least, where chunks have fewer.
WRITER_ROWS = 50_000
# JSON lines in key order take half the time of zlib's own level, and a fifth more bytes.
GZIP = {"compression": CONTENT_ENCODING, "zlib.compress.level": "THREE"}


def write_chunks(
    chunked: DataFrame, staging: Staging, columns=None, attempt: str | None = None,
    order: str = "_row_index", rows_per_file: int | None = None, json_columns=(),
    chunk_count: int | None = None, part: int | None = None,
) -> str:
    """Write ``(stream_name, sequence, <order>, <columns>)`` as one gzip file per chunk.

    Without ``columns`` the row is the struct column ``_row``, whose fields may have any names.

    One shuffle on the chunk number puts a chunk's rows in one task, sorted by ``order``; rows
    travel typed and become JSON only where they are written. With ``rows_per_file`` a chunk is
    instead a set of files written without that shuffle by the tasks that hold the rows: the way
    to stage a whole table as one chunk.

    ``chunk_count`` is how many chunks there are, if known: few chunks get more partitions than
    they need, so that hardly two of them meet in one task.

    A numbered ``part`` of a whole table is written to folders of ``FOLDER_FILES`` files, so that no
    scan and no listing has to take all of them at once.
    """
    attempt = attempt or new_id()
    rows = chunked
    if "partition_key" not in rows.columns:
        rows = rows.withColumn("partition_key", F.lit(DEFAULT_PARTITION))
    keys = ["stream_name", "partition_key", "sequence"]
    if rows_per_file is None:
        # a task per chunk, not per setting of the session: the work of a task does not grow with the table
        rows = rows.repartition(*keys) if chunk_count is None else rows.repartition(min(4 * chunk_count, MOST_WRITERS), *keys)
        rows = rows.sortWithinPartitions(*keys, order)
    record = record_column(rows, columns, json_columns, ROW if columns is None else None)
    folder = F.lit(UNKNOWN)
    if part is not None:
        row = F.expr("monotonically_increasing_id() & 8589934591")
        folder = F.format_string(
            f"{UNKNOWN}-{part:03d}-%09d-%09d", F.spark_partition_id(), F.floor(row / (rows_per_file * FOLDER_FILES)).cast("bigint")
        )
    writer = (
        rows.select(*keys, folder.alias("digest"), record.alias("value"))
        .write.partitionBy(*keys, "digest").mode("append").options(**GZIP)
    )
    if rows_per_file is not None:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.text(staging.attempt(attempt))
    return attempt


ORDER = "_order"


def writers(spark: SparkSession, chunk_count: int, chunk_rows: int) -> int:
    """Tasks that write chunks of so many rows: small chunks share a task, large ones hardly ever do."""
    enough = max(-(-chunk_count * chunk_rows // WRITER_ROWS), 4 * spark.sparkContext.defaultParallelism)
    return min(4 * chunk_count, enough, MOST_WRITERS) if chunk_rows < WRITER_ROWS else min(4 * chunk_count, MOST_WRITERS)


def write_digested(
    rows: DataFrame, staging: Staging, stream: str, attempt: str, chunk_count: int, observed=(), seen: Observation | None = None,
    json_columns=(), chunk_rows: int = WRITER_ROWS,
) -> None:
    """Write packed rows (``_row, sequence, _order``) as one gzip file per chunk, with its digest.

    One shuffle puts a chunk's rows in one task. There they become JSON, their digest is added up and
    names the chunk's folder, so nothing that was staged is read again to describe it. ``observed``
    aggregates go to ``seen`` from the same tasks.
    """
    moved = rows.repartition(writers(rows.sparkSession, chunk_count, chunk_rows), "sequence")
    if seen is not None:
        moved = moved.observe(seen, *observed)
    lines = moved.select("sequence", ORDER, record_column(moved, None, json_columns, ROW).alias("value"))
    whole = W.partitionBy("sequence")
    h = F.xxhash64("value")
    digest = F.concat_ws(
        "-", F.count("*").over(whole).cast("string"),
        F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).over(whole).cast("string"),
        F.sum(F.shiftrightunsigned(h, 32)).over(whole).cast("string"),
    )
    keys = ["stream_name", "partition_key", "sequence", "digest"]
    named = lines.withColumns({"digest": digest, "stream_name": F.lit(stream), "partition_key": F.lit(DEFAULT_PARTITION)})
    (
        named.sortWithinPartitions(*keys, ORDER).select(*keys, "value")
        .write.partitionBy(*keys).mode("append").options(**GZIP).text(staging.attempt(attempt))
    )


def digest_columns(value: Column) -> list[Column]:
    """Aggregates whose values joined by hyphens are a chunk's digest."""
    h = F.xxhash64(value)
    return [
        F.count("*").alias("digest_rows"), F.coalesce(F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))), F.lit(0)).alias("digest_low"),
        F.coalesce(F.sum(F.shiftrightunsigned(h, 32)), F.lit(0)).alias("digest_high"),
    ]


_OWN_PATH = r"/attempt=([^/]+)/stream_name=([^/]+)/partition_key=([^/]+)/sequence=(\d+)/digest=([^/]+)/[^/]+$"


def leaf_folders(spark: SparkSession, staging: Staging, attempt: str) -> list[str]:
    """Folders with the files of an attempt, in the order of their paths."""
    found = [staging.attempt(attempt)]
    for level in ("stream_name=", "partition_key=", "sequence=", "digest="):
        found = [f"{f}/{name}" for f in found for name, _ in sorted(entries(spark, f)) if name.startswith(level)]
    return found


def scan_groups(spark: SparkSession, staging: Staging, attempts: list[str]) -> list[list[str]]:
    """The attempts' folders in groups of ``SCAN_FOLDERS``, one scan each."""
    folders = [f for a in attempts for f in leaf_folders(spark, staging, a)]
    return [folders[i : i + SCAN_FOLDERS] for i in range(0, len(folders), SCAN_FOLDERS)]


def listed_chunks(spark: SparkSession, staging: Staging, attempts: list[str], whole: list[str] = ()) -> DataFrame:
    """Chunks of the attempts from the listing alone: names, digest, files and bytes.

    The ``whole`` ones, of one chunk each, are listed group by group if there are many files.
    """
    paths = [staging.attempt(a) for a in attempts if a not in whole]
    groups = scan_groups(spark, staging, list(whole))
    sibling = packed_files(spark)
    if len(groups) <= 1:
        return _listed(sibling, [*paths, *[f for g in groups for f in g]])
    found = [tuple(r) for g in groups for r in _listed(sibling, g).collect()]  # one row per attempt and group
    columns = "attempt string, stream_name string, partition_key string, sequence bigint, content_hash string, bytes_written bigint, file_count bigint, max_file_bytes bigint"
    summed = local_frame(spark, found, columns).groupBy(*CHUNK_COLUMNS, "content_hash").agg(
        F.sum("bytes_written").alias("bytes_written"), F.sum("file_count").alias("file_count"), F.max("max_file_bytes").alias("max_file_bytes")
    )
    return _listed(sibling, paths).unionByName(summed) if paths else summed


def _listed(spark: SparkSession, paths: list[str]) -> DataFrame:
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.gz")
        .load(paths).select("path", F.col("length"))
    )
    part = lambda i: F.url_decode(F.replace(F.regexp_extract("path", _OWN_PATH, i), F.lit("+"), F.lit("%2B")))
    named = files.select(
        part(1).alias("attempt"), part(2).alias("stream_name"), part(3).alias("partition_key"),
        part(4).cast("bigint").alias("sequence"), F.when(part(5).startswith(UNKNOWN), UNKNOWN).otherwise(part(5)).alias("content_hash"), "length",
    )
    return named.groupBy(*CHUNK_COLUMNS, "content_hash").agg(
        F.sum("length").alias("bytes_written"), F.count("*").alias("file_count"), F.max("length").alias("max_file_bytes"),
    )


def one_file_per_task(spark: SparkSession) -> SparkSession:
    """A sibling session whose file scans never pack two files into one task.

    Gzip files are not split either, so in such a scan a task is exactly one file. The caller's
    settings hold in it as well.
    """
    sibling = _sibling(spark)
    sibling.conf.unset("spark.sql.files.maxPartitionNum")  # it would pack files again
    sibling.conf.set("spark.sql.files.openCostInBytes", str(1 << 60))
    # Rows come file by file, so a task that writes them out by table needs no sort.
    sibling.conf.set("spark.sql.maxConcurrentOutputFileWriters", "100")
    return sibling


def packed_files(spark: SparkSession) -> SparkSession:
    """A sibling session whose file scans pack small files by the hundred into one task."""
    sibling = _sibling(spark)
    sibling.conf.set("spark.sql.files.openCostInBytes", str(32 << 10))
    return sibling


def _sibling(spark: SparkSession) -> SparkSession:
    sibling = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            sibling.conf.set(key, value)
    # each scan lists other files, so listings are not worth keeping
    sibling.conf.set("spark.sql.hive.filesourcePartitionFileCacheSize", "0")
    # tasks that list folders; Spark would take one per folder
    sibling.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(4 * spark.sparkContext.defaultParallelism))
    return sibling


def _attempt_lines(spark, staging, attempts) -> DataFrame:
    return _path_lines(spark, staging, [staging.attempt(a) for a in attempts])


def _path_lines(spark, staging, paths) -> DataFrame:
    return (
        spark.read.format("text").schema(_OWN_SCHEMA)
        .option("basePath", staging.chunks).load(paths)
        .withColumns({"_file": F.col("_metadata.file_path"), "_bytes": F.col("_metadata.file_size")})
    )


def _no_lines(spark) -> DataFrame:
    return local_frame(spark, [], _OWN_SCHEMA + ", _file string, _bytes bigint")


def _lines(spark, staging, attempts) -> DataFrame:
    """Lines of the attempts, which all must have files: a missing one is an error."""
    return _attempt_lines(spark, staging, attempts) if attempts else _no_lines(spark)


def summarize_lines(lines: DataFrame, *keys: str) -> DataFrame:
    """Per chunk: rows, bytes, files and content digest of the staged lines.

    A file is read by one task, so the first grouping is finished on the map side and only one
    row per file is shuffled.
    """
    value = F.when(not_blank(F.col("value")), strip(F.col("value")))
    per_file = lines.groupBy(*keys, "_file").agg(
        F.count(value).alias("rows"), F.max("_bytes").alias("bytes"),
        content_digest(value).alias("digest"),
    )
    part = lambda i: F.conv(F.split("digest", "-")[i], 16, 10).cast("decimal(20,0)")
    return per_file.groupBy(*keys).agg(
        F.sum("rows").alias("row_count"),
        F.sum("bytes").alias("bytes_written"),
        F.concat_ws(
            "-", F.sum("rows").cast("string"),
            F.sum(part(1)).cast("string"), F.sum(part(2)).cast("string"),
        ).alias("content_hash"),
        F.count("*").alias("file_count"),
        F.max("bytes").alias("max_file_bytes"),
    )


EMPTY_HASH = "0-0-0"


def chunk_manifest(
    spark: SparkSession, staging: Staging, attempts: list[str], fingerprints=None,
    empty_chunks=(), digests: dict[str, str | None] | None = None,
) -> DataFrame:
    """Manifest rows of a run's attempts, from the files that were really written.

    ``fingerprints`` maps streams to schema fingerprints; ``empty_chunks`` lists the
    ``(attempt, stream, sequence)`` of tables that staged one empty chunk. ``digests`` names the
    attempts written with their digests, in the folders' names (None) or, for one chunk, given here.
    Only other attempts are read to be counted.
    """
    digests = digests or {}
    found = summarize_lines(_lines(spark, staging, [a for a in attempts if a not in digests]), *CHUNK_COLUMNS)
    if digests:
        given = local_frame(spark, [(a, d) for a, d in digests.items()], "attempt string, _given string")
        listed = listed_chunks(spark, staging, list(digests), [a for a, d in digests.items() if d]).join(F.broadcast(given), "attempt")
        listed = listed.withColumn("content_hash", F.coalesce("_given", "content_hash")).drop("_given")
        rows = F.split("content_hash", "-")[0].cast("bigint")
        found = found.unionByName(listed.withColumn("row_count", rows).select(*found.columns))
    empty = [(a, s, DEFAULT_PARTITION, n, 0, 0, EMPTY_HASH, 0, 0) for a, s, n in empty_chunks]
    if empty:
        columns = (
            "attempt string, stream_name string, partition_key string, sequence bigint, "
            "row_count bigint, bytes_written bigint, content_hash string, file_count bigint, "
            "max_file_bytes bigint"
        )
        found = found.unionByName(local_frame(spark, empty, columns))
    prints = fingerprints or {}
    fingerprint = F.lit(None).cast("string")
    if prints:
        pairs = [F.lit(x) for kv in prints.items() for x in kv]
        fingerprint = F.try_element_at(F.create_map(*pairs), F.col("stream_name"))
    return select_as(describe_chunks(found, staging, fingerprint), MANIFEST)


def describe_chunks(chunks: DataFrame, staging: Staging, fingerprint=None) -> DataFrame:
    """Add the descriptive manifest columns to ``(stream_name, partition_key, sequence, …)``."""
    return chunks.withColumns(
        {
            "pipeline_name": F.lit(staging.pipeline),
            "bucket": F.lit(staging.bucket),
            "object_key": staging.key(),
            "content_type": F.lit(CONTENT_TYPE),
            "content_encoding": F.lit(CONTENT_ENCODING),
            "schema_fingerprint": F.lit(None).cast("string") if fingerprint is None else fingerprint,
            "created_at_unix_ms": now_ms(),
        }
    )


def commit_manifest(manifest: DataFrame, staging: Staging, run: str) -> DataFrame:
    """Store a run's manifest, which makes its chunks visible, and return it stored."""
    path = f"{staging.manifests}/run={run}"
    manifest.write.mode("overwrite").parquet(path)
    return manifest.sparkSession.read.schema(MANIFEST).parquet(path)


def read_manifest(spark: SparkSession, staging: Staging, all_attempts: bool = True) -> DataFrame:
    """Committed chunks; a key staged again counts once, as its newest attempt, unless
    ``all_attempts``."""
    stored = read_or_none(spark, staging.manifests, MANIFEST)
    if stored is None:
        return local_frame(spark, [], MANIFEST)
    rows = select_as(stored, MANIFEST)
    if all_attempts:
        return rows
    newest = W.partitionBy("object_key").orderBy(F.desc("attempt"))
    return rows.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def remove_loaded(
    spark: SparkSession, staging: Staging, applied: DataFrame, grace_ms: int = 86_400_000, now_ms: int | None = None
) -> int:
    """Delete attempts whose chunks are all applied, or newer attempts replaced, and attempts nobody
    committed; returns how many went.

    Manifests go before the files they name, and with a run's last attempt. Nothing younger than
    ``grace_ms`` is touched: a load that began with an older manifest finishes.
    """
    before = (int(time.time() * 1000) if now_ms is None else now_ms) - grace_ms
    manifest = read_or_none(spark, staging.manifests, T.StructType([*MANIFEST.fields, T.StructField("run", T.StringType())]))
    open_attempts: set[str] = set()
    runs: dict[str, set[str]] = {}
    if manifest is not None:
        newest = read_manifest(spark, staging, all_attempts=False).select("object_key", "attempt")
        waiting = newest.join(applied.select("object_key"), "object_key", "left_anti")
        open_attempts = {r[0] for r in waiting.select("attempt").distinct().collect()}  # one row per staged table of a run
        for r in manifest.select("run", "attempt").distinct().collect():
            runs.setdefault(r["run"], set()).add(r["attempt"])
    young = {a.split("=", 1)[1] for a, at in entries(spark, staging.chunks) if a.startswith("attempt=") and at >= before}
    for run, attempts in runs.items():
        if not attempts & (open_attempts | young):
            delete(spark, f"{staging.manifests}/run={run}")
    kept = {a for attempts in runs.values() if attempts & (open_attempts | young) for a in attempts}
    removed = 0
    for name, _ in entries(spark, staging.chunks):
        attempt = name.split("=", 1)[-1]
        if name.startswith("attempt=") and attempt not in kept | young:
            removed += delete(spark, f"{staging.chunks}/{name}")
    return removed


def check_manifest_bucket(manifest: DataFrame, bucket: str) -> int:
    """Refuse chunks that belong to another bucket; returns the number of chunks."""
    foreign = ~F.col("bucket").eqNullSafe(F.lit(bucket))
    row = manifest.agg(
        F.count("*").alias("n"), F.count_if(foreign).alias("foreign"),
        F.max(F.when(foreign, F.col("bucket"))).alias("bucket"),
    ).first()
    if row["foreign"]:
        raise ValueError(f"these chunks lie in bucket {row['bucket']}, this area is {bucket}")
    return row["n"]


# ---------------------------------------------------------------- reading


def _numbered_in_file(rows: DataFrame, keys) -> DataFrame:
    position = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return rows.select(
        *keys, "_file", (position + F.lit(1)).alias("_row_number"), strip(F.col("value")).alias("value")
    )


def number_lines(lines: DataFrame, keys, multi_file: bool = False, tasks: int | None = None) -> DataFrame:
    """Add ``_row_number``: the 1-based position among the non-blank lines of a chunk.

    ``lines`` comes from ``one_file_per_task``, so a line's position in its task is its position
    in its file and nothing is shuffled or sorted. Chunks of several files add the line counts
    of their earlier files, one small row per file, which are counted at once, in ``tasks`` tasks.
    """
    rows = lines.filter(not_blank(F.col("value")))
    numbered = _numbered_in_file(rows, keys)
    if not multi_file:
        return numbered.drop("_file")
    before = W.partitionBy(*keys).orderBy("_file").rowsBetween(W.unboundedPreceding, -1)
    spark, path = lines.sparkSession, scratch_path(lines.sparkSession, "sizes")
    counted = rows if tasks is None else rows.coalesce(tasks)
    counted.groupBy(*keys, "_file").agg(F.count("*").alias("_n")).write.parquet(path)
    named = [f for f in lines.schema if f.name in (*keys, "_file")]
    sizes = read_or_none(spark, path, T.StructType([*named, T.StructField("_n", T.LongType())]))
    starts = sizes.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return join_by_file(numbered, starts).select(
        *keys, (F.col("_row_number") + F.col("_start")).alias("_row_number"), "value"
    )


def copied_lines(spark: SparkSession, staging: Staging, attempt: str, size: int) -> DataFrame:
    """``number_lines`` for a chunk of more files than one scan should have.

    The files are read group by group into the scratch folder, with each line's position in its file;
    the lines of earlier files are then added up from there. The result is a frame of few files.
    """
    path = scratch_path(spark, "lines")
    sibling = one_file_per_task(spark)
    groups = scan_groups(spark, staging, [attempt])
    tasks = reading_tasks(spark, size // max(len(groups), 1))
    for group in groups:
        lines = _path_lines(sibling, staging, group)
        rows = _numbered_in_file(lines.filter(not_blank(F.col("value"))), CHUNK_COLUMNS)
        rows.coalesce(tasks).write.mode("append").parquet(path)
    schema = _LINE_KEYS + ", _file string, _row_number bigint, value string"
    copied = read_or_none(spark, path, schema)
    starts, _ = file_offsets(copied.groupBy("_file").agg(F.count("*").alias("_n")))
    return join_by_file(copied, starts).select(*CHUNK_COLUMNS, (F.col("_row_number") + F.col("_offset")).alias("_row_number"), "value")


def file_texts(spark: SparkSession, staging: Staging) -> DataFrame:
    """Lines (``n``) and bytes of text (``bytes``) of each staged ``file``, read group by group."""
    path = scratch_path(spark, "texts")
    sibling = packed_files(spark)
    attempts = sorted(a.split("=", 1)[1] for a, _ in entries(spark, staging.chunks) if a.startswith("attempt="))
    for group in scan_groups(spark, staging, attempts):
        lines = sibling.read.text(group).withColumn("file", F.col("_metadata.file_path"))
        files = lines.groupBy("file").agg(F.count("*").alias("n"), F.sum(line_bytes(F.col("value"))).alias("bytes"))
        files.write.mode("append").parquet(path)
    schema = "file string, n bigint, bytes bigint"
    found = read_or_none(spark, path, schema)
    return local_frame(spark, [], schema) if found is None else found


# Compressed bytes one task reads; some ten times as much as text.
TASK_BYTES = 32 << 20


def reading_tasks(spark: SparkSession, compressed_bytes: int) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-compressed_bytes // TASK_BYTES))


def read_chunks(spark: SparkSession, staging: Staging, chunks: DataFrame) -> DataFrame:
    """Numbered lines of the given manifest rows: ``object_key, stream_name, partition_key,
    sequence, _row_number, value``; every value is checked to be JSON.

    Attempts that are wanted whole are read by folder. Only when some of an attempt's chunks
    are wanted does a semi-join pick them.
    """
    sides = read_manifest(spark, staging).select(
        "attempt", F.lit(0).alias("n"), F.lit(0).alias("files"), F.lit(0).alias("bytes")
    )
    sides = sides.unionByName(
        chunks.select("attempt", F.lit(1).alias("n"), F.col("file_count").alias("files"),
                      F.col("bytes_written").alias("bytes"))
    )
    # One row per staged table of a run.
    attempts = (
        sides.groupBy("attempt")
        .agg(F.sum("n").alias("n"), F.count_if(F.col("n") == 0).alias("total"),
             F.max("files").alias("files"), F.sum("files").alias("all_files"), F.sum("bytes").alias("bytes"))
        .filter("n > 0 and files > 0").collect()  # an empty chunk has no file
    )
    parts = []
    # a table staged as one chunk of very many files, which is wanted whole or not at all
    large = [a for a in attempts if a["n"] == a["total"] == 1 and a["files"] > SCAN_FILES]
    for a in large:
        parts.append(copied_lines(spark, staging, a["attempt"], a["bytes"] or 0))
    for partly in (False, True):
        group = [a for a in attempts if (a["n"] < a["total"]) == partly and a not in large]
        if not group:
            continue
        lines = _lines(one_file_per_task(spark), staging, [a["attempt"] for a in group])
        multi = max(a["files"] or 0 for a in group) > 1
        tasks = reading_tasks(spark, sum(a["bytes"] or 0 for a in group))
        numbered = number_lines(lines, CHUNK_COLUMNS, multi, tasks if tasks < sum(a["all_files"] for a in group) else None)
        if partly:
            numbered = numbered.join(
                broadcast_if_small(chunks.select(*CHUNK_COLUMNS)), list(CHUNK_COLUMNS), "left_semi"
            )
        # Small files share a task, one after the other; nothing is shuffled.
        parts.append(numbered.coalesce(tasks) if tasks < sum(a["all_files"] for a in group) else numbered)
    if not parts:
        parts = [number_lines(_no_lines(spark), CHUNK_COLUMNS)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(
        staging.key().alias("object_key"), "stream_name", "partition_key", "sequence",
        "_row_number", checked_json(F.col("value")).alias("value"),
    )


def read_staged(spark: SparkSession, staging: Staging, streams=None) -> DataFrame:
    """Lines of every staged chunk, in either layout, or of the named streams only."""

    def wanted(chunks):
        return chunks if streams is None else chunks.filter(F.col("stream_name").isin(list(streams)))

    lines = read_chunks(spark, staging, wanted(read_manifest(spark, staging, all_attempts=False)))
    foreign = adopt_foreign_chunks(spark, staging)
    if foreign is not None:
        lines = lines.unionByName(read_foreign_chunks(spark, staging, wanted(foreign)))
    return in_session(spark, lines)


def in_session(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The same rows as a frame of the caller's session, whose views and settings then apply."""
    name = f"staged_{uuid.uuid4().hex}"
    rows.createGlobalTempView(name)
    try:
        return spark.table(f"global_temp.{name}")
    finally:
        spark.catalog.dropGlobalTempView(name)


def list_chunks(spark: SparkSession, staging: Staging) -> DataFrame:
    """Chunk inventory by stream and sequence; an unknown pipeline has none."""
    own = read_manifest(spark, staging, all_attempts=False)
    foreign = list_foreign_chunks(spark, staging)
    rows = own if foreign is None else own.unionByName(select_as(foreign, MANIFEST))
    return rows.orderBy("stream_name", "sequence")


# ------------------------------------------------- chunks staged by other tools

_FOREIGN = r"/streams/([^/]+)/partitions/([^/]+)/chunks/([^/]*)\.jsonl\.gz$"


def _foreign_columns(file: Column) -> dict[str, Column]:
    path = F.url_decode(F.replace(file, F.lit("+"), F.lit("%2B")))
    digits = F.regexp_extract(path, _FOREIGN, 3)
    bad = F.raise_error(F.concat(F.lit("no chunk number in file name "), path))
    return {
        "stream_name": F.regexp_extract(path, _FOREIGN, 1),
        "partition_key": F.regexp_extract(path, _FOREIGN, 2),
        "sequence": F.when(digits.rlike("^[0-9]+$"), digits.cast("bigint")).otherwise(bad),
    }


def _foreign_files(spark, staging: Staging, file_format: str) -> DataFrame:
    reader = spark.read.format(file_format).option("pathGlobFilter", "*.jsonl.gz")
    return reader.option("recursiveFileLookup", True).load(f"{staging.chunks}/streams")


def list_foreign_chunks(spark: SparkSession, staging: Staging) -> DataFrame | None:
    """Files of the other layout, from the listing alone; names not ending in ``.jsonl.gz`` are
    ignored and a bad sequence number is an error."""
    if not path_exists(spark, f"{staging.chunks}/streams"):
        return None
    files = _foreign_files(spark, staging, "binaryFile").select("path", "length", "modificationTime")
    rows = files.filter(F.col("path").rlike(_FOREIGN)).withColumns(_foreign_columns(F.col("path")))
    rows = rows.withColumnRenamed("length", "bytes_written").withColumns(
        {"file_count": F.lit(1), "max_file_bytes": F.col("bytes_written")}
    )
    modified = F.unix_millis("modificationTime")
    return describe_chunks(rows, staging).withColumn("created_at_unix_ms", modified).drop("modificationTime")


def _foreign_lines(spark, paths: list[str]) -> DataFrame:
    return foreign_columns(spark.read.text(paths))


def foreign_columns(lines: DataFrame) -> DataFrame:
    """Lines of text files of the other layout with their chunk and file; of other files none."""
    files = lines.withColumns({
        "_file": F.col("_metadata.file_path"), "_bytes": F.col("_metadata.file_size"),
        "_modified": F.unix_millis("_metadata.file_modification_time"),
    })
    return files.filter(F.col("_file").rlike(_FOREIGN)).withColumns(_foreign_columns(F.col("_file")))


def adopt_foreign_chunks(spark: SparkSession, staging: Staging) -> DataFrame | None:
    """Manifest rows, with real row counts and digests, for chunks of the other layout.

    A file is digested when it is first seen, or seen with another length or time, and its row is
    kept beside the manifests; otherwise the kept row serves and no text is read.
    """
    listed = list_foreign_chunks(spark, staging)
    if listed is None:
        return None
    keys, same = ["stream_name", "partition_key", "sequence"], ["object_key", "bytes_written", "created_at_unix_ms"]
    kept = read_or_none(spark, staging.adopted, MANIFEST)
    kept = local_frame(spark, [], MANIFEST) if kept is None else select_as(kept, MANIFEST)
    known = kept.join(listed.select(*same), same, "left_semi").dropDuplicates(same)
    fresh = listed.join(known.select(*same), same, "left_anti")
    paths = [r[0] for r in fresh.select("path").collect()]  # one row per new chunk
    if not paths:
        return select_as(known, MANIFEST)
    counted = summarize_lines(_foreign_lines(spark, paths), *keys)
    found = fresh.select(*keys, "bytes_written", "created_at_unix_ms").join(counted.drop("bytes_written"), keys, "left")
    found = found.withColumns(
        {"row_count": F.coalesce("row_count", F.lit(0)), "content_hash": F.coalesce("content_hash", F.lit(EMPTY_HASH))}
    )
    return select_as(known, MANIFEST).unionByName(keep_adopted(found, staging))


def keep_adopted(found: DataFrame, staging: Staging) -> DataFrame:
    """Store counted chunks of the other layout as manifest rows, and return them stored."""
    rows = found.withColumns({"file_count": F.lit(1), "max_file_bytes": F.col("bytes_written")})
    described = describe_chunks(rows.withColumnRenamed("created_at_unix_ms", "_modified"), staging)
    folder = f"{staging.adopted}/run={new_id()}"
    select_as(described.withColumn("created_at_unix_ms", F.col("_modified")), MANIFEST).write.parquet(folder)
    return found.sparkSession.read.schema(MANIFEST).parquet(folder)


def read_foreign_chunks(spark: SparkSession, staging: Staging, chunks: DataFrame) -> DataFrame:
    """``read_chunks`` for the other layout."""
    keys = ["stream_name", "partition_key", "sequence"]
    listed = list_foreign_chunks(spark, staging)
    wanted = [r[0] for r in listed.join(chunks.select(*keys), keys, "left_semi").select("path").collect()]
    sibling = one_file_per_task(spark)
    lines = _foreign_lines(sibling, wanted) if wanted else _no_lines(sibling)
    numbered = number_lines(lines, keys)
    return numbered.select(
        staging.key().alias("object_key"), *keys, "_row_number",
        checked_json(F.col("value")).alias("value"),
    )
