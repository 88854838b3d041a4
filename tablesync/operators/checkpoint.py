"""Progress rows and the checkpoint ledger: one row per (pipeline, table)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.functions.cursor import cursor_text, newer_cursor
from tablesync.model import FULL, INCREMENTAL, LEDGER, MODES, NONE, PROGRESS, select_as
from tablesync.operators.chunking import ROW, SEQUENCE
from tablesync.session import now_ms
from tablesync.sources.capture import last_position

MAX_BIGINT = (1 << 63) - 1


def table_progress(
    chunked: DataFrame, table: str, start_sequence: int = 0, cursor: str | None = None,
    key=(), finished: bool = True, unchunked: bool = False,
) -> DataFrame:
    """One progress row from a table's chunked rows, in one aggregation of the needed columns.

    ``finished`` is False when a cap cut the table. An unchunked capture always uses up one
    sequence number, also when it was empty.
    """
    fallback = F.lit(start_sequence + (1 if unchunked else 0)).cast("bigint")
    row = chunked.agg(
        F.coalesce(F.max(SEQUENCE) + 1, fallback).alias("next_sequence"),
        *progress_columns(chunked, cursor, key),
    )
    row = row.withColumns(
        {
            "table_name": F.lit(table),
            "finished": F.lit(finished),
            "cursor_type": F.lit(row_schema(chunked)[cursor].dataType.simpleString() if cursor else None).cast("string"),
        }
    )
    return select_as(row, PROGRESS)


def row_schema(rows: DataFrame) -> T.StructType:
    """Columns of the table whose rows these are, packed or not."""
    return rows.schema[ROW].dataType if ROW in rows.columns else rows.schema


def row_field(rows: DataFrame):
    """How to name a column of the table whose rows these are."""
    return (lambda c: F.col(ROW).getField(c)) if ROW in rows.columns else (lambda c: F.col(f"`{c}`"))


def progress_columns(rows: DataFrame, cursor: str | None = None, key=()) -> list[Column]:
    """Aggregates of a capture: rows, greatest cursor, last key. They may be observed on a write."""
    schema, at = row_schema(rows), row_field(rows)
    return [
        F.count("*").alias("rows_emitted"),
        (cursor_text(F.max(at(cursor)), schema[cursor].dataType) if cursor else F.max(F.lit(None).cast("string")))
        .alias("max_cursor_value"),
        (last_position(schema, key, at) if key else F.max(F.lit(None).cast("string"))).alias("last_key"),
    ]


def saturating_add(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_add(a, b), F.lit(MAX_BIGINT))


def fold_checkpoint(ledger: DataFrame, manifest: DataFrame) -> DataFrame:
    """Ledger after the manifest's chunks were staged.

    Each staged table moves to the number after its last chunk, adds the staged rows, remembers
    the last chunk's key and is open again; other tables stay as they are.
    """
    staged = manifest.groupBy("pipeline_name", F.col("stream_name").alias("table_name")).agg(
        (F.max(SEQUENCE) + 1).alias("_next"),
        F.sum("row_count").alias("_rows"),
        F.max_by("object_key", SEQUENCE).alias("_key"),
    )
    joined = ledger.join(staged, ["pipeline_name", "table_name"], "full")
    is_staged = F.col("_next").isNotNull()
    rows = F.coalesce("rows_staged", F.lit(0)).cast("bigint")
    return select_as(
        joined.withColumns(
            {
                "next_sequence": F.coalesce("_next", "next_sequence"),
                "rows_staged": saturating_add(rows, F.coalesce("_rows", F.lit(0)).cast("bigint")),
                "last_chunk_key": F.coalesce("_key", "last_chunk_key"),
                "completed": F.when(is_staged, F.lit(False)).otherwise(F.col("completed")),
                "updated_at_unix_ms": F.when(is_staged, now_ms()).otherwise(
                    F.col("updated_at_unix_ms")
                ),
            }
        ),
        LEDGER,
    )


def apply_progress(ledger: DataFrame, progress: DataFrame, pipeline: str) -> DataFrame:
    """Take over cursors and keys (a null never clears a stored one) and completion.

    A cursor never moves back: a capture that reads again what came before, or whose newest rows
    were deleted at the source, keeps the stored one.
    """
    new = progress.select(
        F.lit(pipeline).alias("pipeline_name"), "table_name",
        F.col("max_cursor_value").alias("_cursor"), F.col("cursor_type").alias("_type"),
        F.col("last_key").alias("_last_key"), F.col("finished").alias("_finished"),
        F.col("next_sequence").alias("_next"),
    )
    joined = ledger.join(new, ["pipeline_name", "table_name"], "full")
    return select_as(
        joined.withColumns(
            {
                "last_cursor_value": newer_cursor(
                    F.col("_cursor"), F.col("last_cursor_value"),
                    F.when(F.col("cursor_type") == F.col("_type"), F.col("_type")),
                ),
                "cursor_type": F.when(F.col("_cursor").isNotNull(), F.col("_type")).otherwise(
                    F.col("cursor_type")
                ),
                "last_key": F.coalesce("_last_key", "last_key"),
                "completed": F.when(F.col("_finished"), F.lit(True)).otherwise(
                    F.coalesce("completed", F.lit(False))
                ),
                "next_sequence": F.coalesce("next_sequence", "_next"),
                "rows_staged": F.coalesce("rows_staged", F.lit(0)),
                "updated_at_unix_ms": F.when(F.col("_next").isNotNull(), now_ms()).otherwise(
                    F.col("updated_at_unix_ms")
                ),
            }
        ),
        LEDGER,
    )


def update_cursor(ledger: DataFrame, cursors: DataFrame) -> DataFrame:
    """Move cursors up to those of ``(pipeline_name, table_name, cursor_value)``; nulls change nothing.

    A ledger row that does not know its cursor's type takes any new value.
    """
    joined = ledger.join(cursors, ["pipeline_name", "table_name"], "full")
    return select_as(
        joined.withColumns(
            {
                "last_cursor_value": newer_cursor(F.col("cursor_value"), F.col("last_cursor_value"), F.col("cursor_type")),
                "next_sequence": F.coalesce("next_sequence", F.lit(0)),
                "rows_staged": F.coalesce("rows_staged", F.lit(0)),
                "completed": F.coalesce("completed", F.lit(False)),
                "updated_at_unix_ms": F.when(F.col("cursor_value").isNotNull(), now_ms())
                .otherwise(F.col("updated_at_unix_ms")),
            }
        ),
        LEDGER,
    )


def mark_complete(ledger: DataFrame, tables: DataFrame) -> DataFrame:
    """Complete the tables named by ``(pipeline_name, table_name)``."""
    named = tables.select("pipeline_name", "table_name").distinct().withColumn("_done", F.lit(True))
    joined = ledger.join(named, ["pipeline_name", "table_name"], "full")
    return select_as(
        joined.withColumns(
            {
                "completed": F.coalesce("_done", "completed", F.lit(False)),
                "next_sequence": F.coalesce("next_sequence", F.lit(0)),
                "rows_staged": F.coalesce("rows_staged", F.lit(0)),
                "updated_at_unix_ms": F.when(F.col("_done"), now_ms())
                .otherwise(F.col("updated_at_unix_ms")),
            }
        ),
        LEDGER,
    )


def pending_tables(
    requested: DataFrame, ledger: DataFrame, pipeline: str, mode: str = FULL, resume: bool = True
) -> DataFrame:
    """Tables still to capture and where each one starts.

    Full mode drops completed tables and resumes the others above their last key; incremental
    mode keeps every table and carries its cursor; mode ``none`` captures nothing. Sequence
    numbers always go on, so object keys do not repeat. ``resume=False`` starts afresh.
    """
    if mode not in MODES:
        raise ValueError(f"unknown snapshot mode {mode!r}")
    known = ledger.filter(F.col("pipeline_name") == pipeline).drop("pipeline_name")
    if not resume:
        known = known.limit(0)
    rows = requested.select("table_name").distinct().join(known, "table_name", "left")
    if mode == NONE:
        rows = rows.limit(0)
    if mode == FULL:
        rows = rows.filter(~F.coalesce("completed", F.lit(False)))
    incremental = F.lit(mode == INCREMENTAL)
    return rows.select(
        "table_name",
        F.coalesce("next_sequence", F.lit(0)).cast("bigint").alias("start_sequence"),
        F.when(incremental, F.col("last_cursor_value")).alias("last_cursor_value"),
        F.when(incremental, F.col("cursor_type")).alias("cursor_type"),
        F.when(~incremental, F.col("last_key")).alias("last_key"),
    )


def resume_summary(ledger: DataFrame) -> DataFrame:
    return ledger.agg(
        F.count_if("completed").alias("completed_tables"),
        F.count_if(~F.col("completed")).alias("resumable_tables"),
        F.coalesce(F.sum("rows_staged"), F.lit(0)).alias("rows_staged"),
    )
