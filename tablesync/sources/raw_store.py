"""Raw tables on a file system, loaded exactly once with plain parquet.

Layout of a target::

    <path>/raw/raw_table=<T>/_load_id=<L>/part-*.parquet      the rows
    <path>/applied/_load_id=<L>/part-*.parquet                one row per loaded chunk
    <path>/commits/part-*.parquet                             one row per finished load
    <path>/compactions/<20 digits>                            loads that were rewritten as one

A load writes its rows, then its applied rows, then one commit row in a single file. Readers see
only committed load ids, which prunes whole folders, so a load that dies leaves rows nobody sees
and its retry duplicates nothing. ``compact`` rewrites finished loads as one, without superseded rows,
and one small file makes that visible; what it replaced stays until ``vacuum``, so running readers
of the old loads go on.
"""

from __future__ import annotations

import json
import re
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablesync.functions.names import check_raw_idents, raw_ident
from tablesync.model import APPLIED, DEFAULT_RAW_PREFIX, DEFAULT_RAW_SCHEMA
from tablesync.operators.load import (
    chunk_states, check_conflicts, load_report, raw_envelope, record_applied,
)
from tablesync.session import local_frame, new_id, now_ms, read_or_none
from tablesync.sources.commits import commit, delete, entries, newest_commit

_RAW = (
    "_object_key string, _sequence bigint, _row_number bigint, _loaded_at timestamp, "
    "_data string, raw_table string, _load_id string"
)
_COMMITS = "load_id string, committed_at_unix_ms bigint, replaced bigint"
# Committed load ids up to this many become a literal list that prunes folders at planning.
LISTED_LOADS = 10_000
DAY_MS = 86_400_000


@dataclass(frozen=True)
class RawStore:
    path: str
    schema: str = DEFAULT_RAW_SCHEMA
    prefix: str = DEFAULT_RAW_PREFIX
    # Most rows per file; None leaves a task's rows in one file per table.
    batch_size: int | None = None

    def __post_init__(self):
        if self.batch_size is not None and self.batch_size <= 0:
            raise ValueError("a file needs room for one row at least: batch_size is below 1")

    def _part(self, name: str) -> str:
        return f"{self.path.rstrip('/')}/{self.schema}/{name}"

    def commits(self, spark: SparkSession) -> DataFrame:
        rows = read_or_none(spark, self._part("commits"), _COMMITS)
        return local_frame(spark, [], _COMMITS) if rows is None else rows

    def _committed(self, rows: DataFrame) -> tuple[DataFrame, bool]:
        """Rows of finished loads, and whether a load ever superseded chunks of another."""
        commits = self.commits(rows.sparkSession)
        whole, covered = self._compacted(rows.sparkSession)
        if whole is not None:
            gone = local_frame(rows.sparkSession, [(c,) for c in covered], "load_id string")
            commits = commits.join(gone, "load_id", "left_anti").select("load_id", "committed_at_unix_ms", "replaced")
            commits = commits.unionByName(local_frame(rows.sparkSession, [(whole, 0, 0)], _COMMITS))
        listed = commits.select("load_id", "replaced").limit(LISTED_LOADS + 1).collect()
        if len(listed) <= LISTED_LOADS:
            ids = sorted({r["load_id"] for r in listed})
            visible = rows.filter(F.col("_load_id").isin(ids) if ids else F.lit(False))
            return visible, any(r["replaced"] for r in listed)
        ids = commits.select(F.col("load_id").alias("_load_id")).distinct()
        replaced = bool(commits.filter("replaced > 0").take(1))
        return rows.join(ids, "_load_id", "left_semi"), replaced

    def _compacted(self, spark: SparkSession) -> tuple[str | None, list[str]]:
        """The load that earlier ones were rewritten to, and the ids of those."""
        _, text = newest_commit(spark, self._part("compactions"))
        state = {"load_id": None, "covers": []} if text is None else json.loads(text)
        return state["load_id"], state["covers"]

    def compact(self, spark: SparkSession) -> int:
        """Rewrite finished loads as one load without superseded rows; returns how many there were.

        The rows of many small files share tasks and become files of a task's size; nothing is
        shuffled. Loads that finish meanwhile stay beside it. The new load's id sorts behind those it
        covers and before any later one, so a later load still supersedes its chunks.
        """
        number, _ = newest_commit(spark, self._part("compactions"))
        whole, covered = self._compacted(spark)
        gone = local_frame(spark, [(c,) for c in covered], "load_id string")
        fresh = self.commits(spark).select("load_id").distinct().join(gone, "load_id", "left_anti")
        oldest = fresh.orderBy("load_id").limit(LISTED_LOADS).collect()
        loads = sorted({r["load_id"] for r in oldest} | ({whole} if whole else set()))
        if len(loads) < 2:
            return 0
        target = f"{re.sub('~.*', '', loads[-1])}~{new_id()}"
        mine = F.col("_load_id").isin(loads)
        rows = self.read(spark).filter(mine).withColumn("_load_id", F.lit(target))
        rows.write.partitionBy("raw_table", "_load_id").mode("append").parquet(self._part("raw"))
        applied = self.applied(spark).filter(mine).withColumn("_load_id", F.lit(target))
        applied.coalesce(1).write.partitionBy("_load_id").mode("append").parquet(self._part("applied"))
        commit(spark, self._part("compactions"), number + 1, json.dumps({"load_id": target, "covers": sorted({*covered, *loads})}))
        return len(loads)

    def vacuum(self, spark: SparkSession, grace_ms: int = DAY_MS, now_ms: int | None = None) -> int:
        """Delete the folders of rewritten loads and of loads that died; returns how many loads went.

        Only what is older than ``grace_ms`` goes, so readers that began before a compaction, and
        loads under way, keep their files.
        """
        before = (int(time.time() * 1000) if now_ms is None else now_ms) - grace_ms
        whole, covered = self._compacted(spark)
        finished = {r["load_id"] for r in self.commits(spark).select("load_id").distinct().collect()}
        live = (finished - set(covered)) | ({whole} if whole else set())
        since = dict(entries(spark, self._part("compactions")))
        settled = max(since.values(), default=before) < before
        gone = set()
        raw = self._part("raw")
        folders = [f"{raw}/{t}" for t, _ in entries(spark, raw) if t.startswith("raw_table=")] + [self._part("applied")]
        for folder in folders:
            for name, written in entries(spark, folder):
                load = name.split("=", 1)[-1]
                if not name.startswith("_load_id=") or load in live or written >= before:
                    continue
                if load in finished and not settled:
                    continue
                delete(spark, f"{folder}/{name}")
                gone.add(load)
        return len(gone)

    def applied(self, spark: SparkSession) -> DataFrame:
        """Applied chunks, the newest load of each key."""
        rows = read_or_none(spark, self._part("applied"), APPLIED)
        if rows is None:
            return local_frame(spark, [], APPLIED)
        visible, replaced = self._committed(rows)
        if not replaced:
            return visible
        newest = W.partitionBy("object_key").orderBy(F.desc("_load_id"))
        return visible.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")

    def read(self, spark: SparkSession, stream: str | None = None) -> DataFrame:
        """Visible raw rows of one stream, or of all with their ``raw_table``."""
        rows = read_or_none(spark, self._part("raw"), _RAW)
        if rows is None:
            rows = local_frame(spark, [], _RAW)
        if stream is not None:
            rows = rows.filter(F.col("raw_table") == raw_ident(stream, self.prefix))
        visible, replaced = self._committed(rows)
        if replaced:
            newest = self.applied(spark).select(F.col("object_key").alias("_object_key"), "_load_id")
            visible = visible.join(newest, ["_object_key", "_load_id"], "left_semi")
        return visible

    def append(
        self, lines: DataFrame, chunks: DataFrame, replaced: int = 0, load_id: str | None = None
    ) -> DataFrame:
        """Load numbered lines of ``chunks`` as one unit; returns their applied rows."""
        spark = lines.sparkSession
        load_id = load_id or new_id()
        self.write_rows(lines, load_id)
        applied = self.write_applied(chunks, load_id)
        self.commit(spark, load_id, replaced)
        return applied

    def write_rows(self, lines: DataFrame, load_id: str) -> None:
        rows = raw_envelope(lines, load_id).withColumn(
            "raw_table", raw_ident(F.col("stream_name"), self.prefix)
        )
        writer = rows.drop("stream_name").write.partitionBy("raw_table", "_load_id").mode("append")
        if self.batch_size is not None:
            writer = writer.option("maxRecordsPerFile", self.batch_size)
        writer.parquet(self._part("raw"))

    def write_applied(self, chunks: DataFrame, load_id: str) -> DataFrame:
        spark = chunks.sparkSession
        # Only this load's folders are listed, however many loads there were.
        raw, loads = self._part("raw"), self._part("applied")
        written = read_or_none(spark, f"{raw}/raw_table=*/_load_id={load_id}", _RAW, basePath=raw)
        if written is None:
            written = local_frame(spark, [], _RAW)
        applied = record_applied(chunks, written, load_id)
        applied.write.partitionBy("_load_id").mode("append").parquet(loads)
        stored = read_or_none(spark, f"{loads}/_load_id={load_id}", APPLIED, basePath=loads)
        return local_frame(spark, [], APPLIED) if stored is None else stored

    def commit(self, spark: SparkSession, load_id: str, replaced: int = 0) -> None:
        row = spark.range(1).select(
            F.lit(load_id).alias("load_id"), now_ms().alias("committed_at_unix_ms"),
            F.lit(replaced).cast("bigint").alias("replaced"),
        )
        row.coalesce(1).write.mode("append").parquet(self._part("commits"))

    def load(self, chunks: DataFrame, read, replace: bool = False, load_id: str | None = None):
        """Load the chunks not applied yet and report on all of them.

        ``read`` turns manifest rows into numbered lines. Chunks with an applied key are skipped;
        if their content differs the load fails, or supersedes them with ``replace``.
        """
        spark = chunks.sparkSession
        known = self.applied(spark)
        states = chunk_states(chunks, known)
        seen = states.select("stream_name", "state").unionByName(
            known.select("stream_name", F.lit("known").alias("state"))
        )
        # A few rows per table.
        tally = seen.groupBy("stream_name", "state").count().collect()
        check_raw_idents({r["stream_name"] for r in tally}, self.prefix)
        count = lambda s: sum(r["count"] for r in tally if r["state"] == s)
        conflicts = count("conflict")
        if conflicts:
            check_conflicts(states, replace)
        todo = states.filter("state <> 'applied'").drop("state")
        load_id = load_id or new_id()
        if count("new") or conflicts:
            applied = self.append(read(todo), todo, conflicts, load_id)
        else:
            applied = local_frame(spark, [], APPLIED)
        skipped = chunks.join(
            applied.select("object_key"), "object_key", "left_anti"
        ).withColumn("state", F.lit("applied"))
        return load_report(skipped, applied, self.schema, self.prefix)
