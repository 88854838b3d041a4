"""Source against destination: row counts and row contents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesync.operators.chunking import fresh_names, row_hash
from tablesync.session import SMALL_ROWS, broadcast_if_small, scratch_path


def _sided(df: DataFrame, source: bool) -> DataFrame:
    return df.withColumns({"_src": F.lit(int(source)), "_dst": F.lit(int(not source))})


def reconcile_counts(source: DataFrame, dest: DataFrame, table: str = "table_name") -> DataFrame:
    """Expected and found rows per table. Both sides are counted in one aggregation."""
    both = _sided(source.select(table), True).unionByName(_sided(dest.select(table), False))
    return (
        both.groupBy(table)
        .agg(F.sum("_src").alias("expected"), F.sum("_dst").alias("actual"))
        .withColumn("ok", F.col("expected") == F.col("actual"))
    )


def reconcile_rows(source: DataFrame, dest: DataFrame, key) -> DataFrame:
    """Keys whose rows differ: ``missing`` in the destination, ``extra`` there, or ``changed``.

    The two sides are stacked and grouped, not joined: one shuffle of (key, hash, side), combined
    on the map side, where repeated keys neither multiply nor pile up in one task.
    """
    key = [key] if isinstance(key, str) else list(key)
    if sorted(source.columns) != sorted(dest.columns):
        raise ValueError("source and destination must have the same columns")

    def digest(df, is_source):
        rows = df.select(*source.columns)
        return _sided(rows.select(*key, row_hash(rows).alias("_hash")), is_source)

    both = digest(source, True).unionByName(digest(dest, False))
    low = F.col("_hash").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("_hash", 32)
    sign = F.col("_src") - F.col("_dst")
    grouped = both.groupBy(*key).agg(
        F.sum("_src").alias("source_rows"), F.sum("_dst").alias("dest_rows"),
        F.sum(low * sign).alias("_low"), F.sum(high * sign).alias("_high"),
    )
    same = (
        (F.col("source_rows") == F.col("dest_rows")) & (F.col("_low") == 0) & (F.col("_high") == 0)
    )
    status = (
        F.when(F.col("dest_rows") == 0, "missing").when(F.col("source_rows") == 0, "extra")
        .otherwise("changed")
    )
    return grouped.filter(~same).select(*key, status.alias("status"), "source_rows", "dest_rows")


# Children of a node of the digest tree, as bits of the key's hash.
LEVEL_BITS = 12
LEVELS = 4


def range_digests(source: DataFrame, dest: DataFrame, key, bits: int) -> DataFrame:
    """Ranges of key hashes whose contents differ: ``range``, the rows in them and nothing else.

    A range is named by the first ``bits`` bits. Both sides are counted and their row hashes added
    up in one aggregation whose shuffle has at most one row per range and task.
    """
    def digest(df, is_source):
        hashed = [F.xxhash64(*[F.col(f"`{k}`") for k in key]).alias("_at"), row_hash(df).alias("_hash")]
        return _sided(df.select(*hashed), is_source)

    both = digest(source, True).unionByName(digest(dest, False))
    sign = F.col("_src") - F.col("_dst")
    grouped = both.groupBy(F.shiftrightunsigned("_at", 64 - bits).alias("range")).agg(
        F.count("*").alias("rows"), F.sum(sign).alias("_n"),
        F.sum(F.col("_hash").bitwiseAND(F.lit(0xFFFFFFFF)) * sign).alias("_low"),
        F.sum(F.shiftrightunsigned("_hash", 32) * sign).alias("_high"),
        # two rows swapped between keys of one range would leave the sums as they are
        F.sum(F.xxhash64("_at", "_hash").bitwiseAND(F.lit(0xFFFFFFFF)) * sign).alias("_both"),
    )
    return grouped.filter("_n <> 0 or _low <> 0 or _high <> 0 or _both <> 0").select("range", "rows")


def unequal_ranges(source: DataFrame, dest: DataFrame, key, limit: int = SMALL_ROWS) -> tuple[DataFrame, DataFrame, int]:
    """Both sides cut down to unequal ranges, level by level, and the levels it took.

    Each level looks only at the ranges that differed in the one above. It ends when few enough rows are
    left to compare, when a level no longer halves them (differences everywhere), or at the last level.
    Only ranges that were counted are broadcast.
    """
    spark = source.sparkSession
    rows = None
    for level in range(1, LEVELS + 1):
        bits = level * LEVEL_BITS
        path = scratch_path(spark, "ranges")
        range_digests(source, dest, key, bits).write.parquet(path)
        found = spark.read.schema("range bigint, rows bigint").parquet(path)
        left = found.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"]

        def within(df, found=found, bits=bits):
            at, = fresh_names(df, "_range")
            ranges = broadcast_if_small(found.select(F.col("range").alias(at)), limit)
            place = F.shiftrightunsigned(F.xxhash64(*[F.col(f"`{k}`") for k in key]), 64 - bits)
            return df.withColumn(at, place).join(ranges, at, "left_semi").drop(at)

        source, dest = within(source), within(dest)
        if left <= limit or (rows is not None and 2 * left > rows):
            return source, dest, level
        rows = left
    return source, dest, LEVELS


def reconcile_tree(source: DataFrame, dest: DataFrame, key) -> DataFrame:
    """``reconcile_rows`` by a tree of digests: only rows of unequal key ranges are shuffled.

    Two tables that agree shuffle one small row per range; otherwise the rows compared are those of
    the leaf ranges that hold a difference.
    """
    key = [key] if isinstance(key, str) else list(key)
    if sorted(source.columns) != sorted(dest.columns):
        raise ValueError("source and destination must have the same columns")
    dest = dest.select(*[F.col(f"`{c}`") for c in source.columns])
    mine, theirs, _ = unequal_ranges(source, dest, key)
    return reconcile_rows(mine, theirs, key)
