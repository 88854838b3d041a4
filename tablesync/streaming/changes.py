"""Continuous change apply: backfill a keyed table, then follow its change log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tablesync.operators.cdc import DELETE, PAUSED, SNAPSHOT_PLANNING, initial_phase, newer_changes
from tablesync.operators.writes import latest_by_key
from tablesync.session import local_frame, read_or_none
from tablesync.sources.delta_table import DeltaTable
from tablesync.sources.keyed_table import KeyedTable

LSN, DELETED = "_lsn", "_deleted"
MARK = "snapshot_lsn bigint"


def cdc_table(path: str, key, row_schema: T.StructType, buckets: int = 16, files_per_bucket=1):
    """A keyed table that keeps each row's log position and the keys of deleted rows, so that a
    replayed or late change cannot undo a newer one."""
    fields = [*row_schema.fields, T.StructField(LSN, T.LongType()), T.StructField(DELETED, T.BooleanType())]
    key = (key,) if isinstance(key, str) else tuple(key)
    return KeyedTable(path, key, T.StructType(fields), buckets, files_per_bucket, LSN, DELETED)


def delta_cdc_table(path: str, key, row_schema: T.StructType, buckets: int = 16, tier: int = 4) -> DeltaTable:
    """The same as a table merged on read: a batch of changes writes small runs and no bucket."""
    fields = [*row_schema.fields, T.StructField(LSN, T.LongType()), T.StructField(DELETED, T.BooleanType())]
    key = (key,) if isinstance(key, str) else tuple(key)
    return DeltaTable(path, key, T.StructType(fields), buckets, LSN, DELETED, tier)


def backfill(table: KeyedTable | DeltaTable, snapshot: DataFrame, snapshot_lsn: int) -> bool:
    """Fold a snapshot in at its log position; rows changed since are left alone.

    A mark beside the table says so, and a snapshot with a mark is not folded in again.
    """
    spark = snapshot.sparkSession
    if snapshot_lsn in backfilled(spark, table):
        return False
    table.keep_latest(
        snapshot.withColumns({LSN: F.lit(snapshot_lsn).cast("bigint"), DELETED: F.lit(False)})
    )
    mark = local_frame(spark, [(snapshot_lsn,)], MARK)
    mark.coalesce(1).write.mode("overwrite").parquet(f"{table.path}/backfills/position={snapshot_lsn}")
    return True


def backfilled(spark: SparkSession, table: KeyedTable | DeltaTable) -> list[int]:
    """Log positions of the snapshots folded in, in order."""
    marks = read_or_none(spark, f"{table.path}/backfills", MARK)
    return [] if marks is None else sorted(r[0] for r in marks.select("snapshot_lsn").collect())


def apply_changes(table: KeyedTable | DeltaTable, changes: DataFrame, snapshot_lsn: int | None = None) -> None:
    """Fold one batch of change records above the snapshot into the buckets it touches."""
    rows = newer_changes(changes, snapshot_lsn).withColumns(
        {LSN: F.col("lsn").cast("bigint"), DELETED: F.col("op") == DELETE}
    )
    table.keep_latest(latest_by_key(rows.select(*table.schema.names), list(table.key), LSN))


def cdc_stream(
    changes: DataFrame, table: KeyedTable | DeltaTable, checkpoint: str, mode: str = "none",
    snapshot: DataFrame | None = None, snapshot_lsn: int = 0, continuous: str | None = None,
) -> StreamingQuery | None:
    """Backfill if the mode asks for a snapshot, then tail the streaming change log.

    Returns None when there is nothing to do (no snapshot and no change log).
    """
    phase = initial_phase(mode, changes is not None)
    if phase == PAUSED:
        return None
    if phase == SNAPSHOT_PLANNING and snapshot is not None:
        backfill(table, snapshot, snapshot_lsn)
    if changes is None:
        return None
    done = backfilled(changes.sparkSession, table)
    above = done[-1] if done else None
    writer = changes.writeStream.foreachBatch(lambda batch, _id: apply_changes(table, batch, above)).option(
        "checkpointLocation", checkpoint
    )
    trigger = {"processingTime": continuous} if continuous else {"availableNow": True}
    return writer.trigger(**trigger).start()
