"""Loading staged chunks into raw tables: what to load, its envelope, what was loaded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesync.functions.names import raw_table_name
from tablesync.model import APPLIED, DEFAULT_RAW_PREFIX, DEFAULT_RAW_SCHEMA, REPORT, select_as


class ChunkConflict(ValueError):
    """A chunk key that is already applied was staged again with other content."""


def raw_envelope(lines: DataFrame, load_id: str | None = None) -> DataFrame:
    """Raw rows from numbered chunk lines; ``stream_name`` stays along for routing."""
    return lines.select(
        F.col("object_key").alias("_object_key"),
        F.col("sequence").alias("_sequence"),
        F.col("_row_number"),
        F.current_timestamp().alias("_loaded_at"),
        F.col("value").alias("_data"),
        F.lit(load_id).cast("string").alias("_load_id"),
        "stream_name",
    )


def select_unapplied(manifest: DataFrame, applied: DataFrame) -> DataFrame:
    """Chunks whose key is not applied yet."""
    return manifest.join(applied.select("object_key"), "object_key", "left_anti")


def chunk_states(manifest: DataFrame, applied: DataFrame) -> DataFrame:
    """Every chunk with ``state``: ``new``, ``applied`` or ``conflict`` (same key, other content).

    Chunks applied without a known content hash count as the same.
    """
    known = applied.select(
        "object_key", F.lit(True).alias("_known"), F.col("content_hash").alias("_applied_hash")
    )
    differs = F.col("_applied_hash") != F.col("content_hash")
    return (
        manifest.join(known, "object_key", "left")
        .withColumn(
            "state",
            F.when(F.col("_known").isNull(), "new").when(differs, "conflict").otherwise("applied"),
        )
        .drop("_known", "_applied_hash")
    )


def check_conflicts(states: DataFrame, replace: bool = False) -> None:
    if replace:
        return
    clash = states.filter("state = 'conflict'").select("object_key").take(1)
    if clash:
        raise ChunkConflict(
            f"chunk {clash[0]['object_key']} is applied with other content; "
            "load it with replace=True to supersede it"
        )


def decoded_counts(raw: DataFrame) -> DataFrame:
    """Rows per chunk as they were really decoded, combined before the shuffle."""
    return raw.groupBy(F.col("_object_key").alias("object_key")).agg(
        F.count("*").alias("decoded"), F.max("_row_number").alias("last_row")
    )


def record_applied(chunks: DataFrame, raw: DataFrame, load_id: str | None = None) -> DataFrame:
    """One applied row per chunk; the decoded count corrects a wrong manifest count."""
    joined = chunks.join(decoded_counts(raw), "object_key", "left")
    bad = F.raise_error(F.concat(F.lit("row numbers have gaps in "), F.col("object_key")))
    count = F.coalesce("decoded", F.lit(0))
    gapless = F.coalesce("last_row", F.lit(0)) == count
    return select_as(
        joined.withColumns(
            {
                "row_count": F.when(gapless, count).otherwise(bad.cast("bigint")),
                "loaded_at": F.current_timestamp(),
                "_load_id": F.lit(load_id).cast("string"),
            }
        ),
        APPLIED,
    )


def load_report(
    states: DataFrame, applied: DataFrame, schema: str = DEFAULT_RAW_SCHEMA,
    prefix: str = DEFAULT_RAW_PREFIX,
) -> DataFrame:
    """What became of every offered chunk: rows written, or skipped as already applied."""
    table = raw_table_name(F.col("stream_name"), schema, prefix)
    written = applied.select(
        "object_key", table.alias("table_name"), F.col("row_count").alias("rows_written"),
        F.lit(False).alias("skipped"),
    )
    skipped = states.filter("state = 'applied'").select(
        "object_key", table.alias("table_name"), F.lit(0).cast("bigint").alias("rows_written"),
        F.lit(True).alias("skipped"),
    )
    return select_as(written.unionByName(skipped), REPORT)


def load_totals(report: DataFrame) -> DataFrame:
    return report.agg(
        F.count_if(~F.col("skipped")).alias("chunks_applied"),
        F.coalesce(F.sum("rows_written"), F.lit(0)).alias("rows_written"),
        F.count_if("skipped").alias("chunks_skipped"),
    )
