"""What a job did, as the event tables that the run reports fold.

Each table is an append-only parquet folder: ``status`` has one row per status change of a run,
``tables`` one per state of a table within a run, ``artifacts`` one per staged chunk.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesync.session import local_frame, new_id, read_or_none

STATUS = (
    "run_id string, pipeline_name string, ts timestamp, event_id string, status string, stats_json string, "
    "phase string, progress_current bigint, progress_total bigint"
)
TABLES = (
    "run_id string, stream_name string, ts timestamp, event_id string, status string, rows bigint, chunks bigint, "
    "checkpoint_completed boolean"
)
ARTIFACTS = (
    "pipeline_run_id string, stream_name string, partition_key string, sequence bigint, object_key string, "
    "row_count bigint, bytes_written bigint"
)
SCHEMAS = {"status": STATUS, "tables": TABLES, "artifacts": ARTIFACTS}


@dataclass(frozen=True)
class RunLog:
    path: str

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        rows = read_or_none(spark, f"{self.path}/{table}", SCHEMAS[table])
        return local_frame(spark, [], SCHEMAS[table]) if rows is None else rows

    def _append(self, rows: DataFrame, table: str) -> None:
        names = [c.split()[0] for c in SCHEMAS[table].split(", ")]
        rows.select(*names).write.mode("append").parquet(f"{self.path}/{table}")

    def status(
        self, spark: SparkSession, run: str, pipeline: str, status: str, phase: str | None = None,
        progress: tuple[int, int] | None = None, stats: dict | None = None,
    ) -> None:
        current, total = progress or (None, None)
        row = (run, pipeline, new_id(), status, None if stats is None else json.dumps(stats), phase, current, total)
        frame = local_frame(
            spark, [row], "run_id string, pipeline_name string, event_id string, status string, stats_json string, "
            "phase string, progress_current bigint, progress_total bigint",
        )
        self._append(frame.withColumn("ts", F.current_timestamp()).coalesce(1), "status")

    def tables(self, run: str, manifest: DataFrame, ledger: DataFrame, status: str) -> None:
        """The staged tables' rows and chunks, all in one state."""
        done = ledger.select(F.col("table_name").alias("stream_name"), F.col("completed").alias("checkpoint_completed"))
        rows = manifest.groupBy("stream_name").agg(F.sum("row_count").alias("rows"), F.count("*").alias("chunks"))
        marked = rows.join(done, "stream_name", "left").withColumns(
            {"run_id": F.lit(run), "ts": F.current_timestamp(), "event_id": F.lit(new_id()), "status": F.lit(status)}
        )
        self._append(marked.coalesce(1), "tables")  # one row per table

    def artifacts(self, run: str, manifest: DataFrame) -> None:
        self._append(manifest.withColumn("pipeline_run_id", F.lit(run)), "artifacts")
