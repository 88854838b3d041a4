"""Change records: the latest change per key and applying changes to a snapshot.

A change record has ``op`` (I, U or D), ``lsn`` (its position in the log), the key columns and,
for inserts and updates, the row's columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.functions.codec import JSON_OPTIONS
from tablesync.model import CHANGE_COLUMNS, NONE
from tablesync.operators.writes import latest_by_key

# Operations and phases of a change stream.
INSERT, UPDATE, DELETE = "I", "U", "D"
SNAPSHOT_PLANNING, SNAPSHOT_RUNNING, SNAPSHOT_COMPLETE = (
    "snapshot_planning", "snapshot_running", "snapshot_complete",
)
CDC_STARTING, CDC_RUNNING, PAUSED, FAILED = "cdc_starting", "cdc_running", "paused", "failed"


def checked_changes(changes: DataFrame) -> DataFrame:
    """The changes; one with a null or unknown operation fails the job."""
    known = F.coalesce(F.col("op").isin(INSERT, UPDATE, DELETE), F.lit(False))
    bad = F.raise_error(F.concat(F.lit("unknown change operation "), F.coalesce("op", F.lit("null"))))
    return changes.withColumn("op", F.when(known, F.col("op")).otherwise(bad.cast("string")))


def read_change_log(changes: DataFrame, key, payload: T.StructType | None = None) -> DataFrame:
    """Check a batch or streaming change log, and unpack a JSON ``payload`` column if a schema is
    given. Any source with the columns will do: files, Kafka, a table."""
    key = [key] if isinstance(key, str) else list(key)
    missing = [c for c in (*CHANGE_COLUMNS, *key) if c not in changes.columns]
    if missing:
        raise ValueError(f"change log lacks columns: {', '.join(missing)}")
    checked = checked_changes(changes)
    if payload is None:
        return checked
    parsed = F.from_json("payload", payload, {**JSON_OPTIONS, "mode": "FAILFAST"})
    rest = [f.name for f in payload if f.name not in key]
    return checked.withColumn("_row", parsed).select(
        *CHANGE_COLUMNS, *key, *[F.col(f"_row.{c}").alias(c) for c in rest]
    )


def newer_changes(changes: DataFrame, snapshot_lsn: int | None) -> DataFrame:
    """Checked changes that the snapshot does not contain yet."""
    checked = checked_changes(changes)
    return checked if snapshot_lsn is None else checked.filter(F.col("lsn") > snapshot_lsn)


def cdc_latest(changes: DataFrame, key, lsn: str = "lsn") -> DataFrame:
    """The last change of every key by log position."""
    return latest_by_key(changes, key, lsn)


def cdc_apply(
    snapshot: DataFrame, changes: DataFrame, key, snapshot_lsn: int | None = None
) -> DataFrame:
    """Snapshot rows after the changes above ``snapshot_lsn``.

    Changes are cut to one per key before they meet the snapshot, so the join is one to one; a
    delete of an unknown key has no effect.
    """
    key = [key] if isinstance(key, str) else list(key)
    newer = newer_changes(changes, snapshot_lsn)
    latest = cdc_latest(newer, key)
    untouched = snapshot.join(latest.select(*key), key, "left_anti")
    alive = latest.filter(F.col("op") != DELETE)
    return untouched.unionByName(alive.select(*snapshot.columns))


def initial_phase(mode: str, cdc: bool) -> str:
    """Where a stream starts: at the log's tail without a snapshot, nowhere without either."""
    if mode != NONE:
        return SNAPSHOT_PLANNING
    return CDC_STARTING if cdc else PAUSED


def cdc_progress(changes: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Per stream: phase, last snapshot chunk and last log position."""
    seen = changes.groupBy("stream_name").agg(F.max("lsn").alias("last_lsn"))
    if ledger is None:
        return seen.select(
            "stream_name", F.lit(CDC_RUNNING).alias("phase"),
            F.lit(None).cast("string").alias("last_snapshot_chunk"), "last_lsn",
        )
    chunks = ledger.select(
        F.col("table_name").alias("stream_name"), F.col("last_chunk_key"), "completed"
    )
    phase = (
        F.when(F.col("last_lsn").isNotNull() & F.coalesce("completed", F.lit(True)), CDC_RUNNING)
        .when(F.col("completed"), SNAPSHOT_COMPLETE)
        .otherwise(SNAPSHOT_RUNNING)
    )
    return seen.join(chunks, "stream_name", "full").select(
        "stream_name", phase.alias("phase"), F.col("last_chunk_key").alias("last_snapshot_chunk"),
        "last_lsn",
    )
