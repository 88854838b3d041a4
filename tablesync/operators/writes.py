"""Write modes as set operations on keyed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablesync.operators.chunking import row_hash

_RANK = "_rank"


def latest_by_key(df: DataFrame, key, order, tie_break: bool = True) -> DataFrame:
    """The newest row of each key by the ``order`` columns.

    Spark keeps one row per key and task before the shuffle, so a key with much of the table is
    no hot spot. Equal order values are settled by a hash of the row.
    """
    key = [key] if isinstance(key, str) else list(key)
    order = [order] if isinstance(order, str) else list(order)
    by = [F.col(c).desc_nulls_last() for c in order]
    if tie_break:
        by.append(row_hash(df).desc())
    window = W.partitionBy(*key).orderBy(*by)
    return df.withColumn(_RANK, F.row_number().over(window)).filter(f"{_RANK} = 1").drop(_RANK)


def write_append(target: DataFrame, rows: DataFrame) -> DataFrame:
    """All rows of both, nothing removed."""
    return target.unionByName(rows)


def write_upsert(target: DataFrame, updates: DataFrame, key, order) -> DataFrame:
    """The latest update of each key replaces or adds its row; other rows stay."""
    key = [key] if isinstance(key, str) else list(key)
    newest = latest_by_key(updates, key, order)
    kept = target.join(newest.select(*key), key, "left_anti")
    return kept.unionByName(newest.select(*target.columns))


def write_merge(
    target: DataFrame, updates: DataFrame, key, order, op: str = "op", delete="D"
) -> DataFrame:
    """Upsert that also removes keys whose latest update is a delete."""
    key = [key] if isinstance(key, str) else list(key)
    newest = latest_by_key(updates, key, order)
    kept = target.join(newest.select(*key), key, "left_anti")
    alive = newest.filter(~F.col(op).eqNullSafe(F.lit(delete)))
    return kept.unionByName(alive.select(*target.columns))


def write_replace(target: DataFrame, rows: DataFrame) -> DataFrame:
    """The new rows instead of the old, in the target's column order."""
    return rows.select(*target.columns)
