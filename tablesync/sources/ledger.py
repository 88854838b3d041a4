"""The stored ledger: every save is a new version, readers take the newest.

Layout::

    <root>/<pipeline>.snapshot-checkpoints/rows/save=<id>/part-*.parquet   a ledger
    <root>/<pipeline>.snapshot-checkpoints/commits/<20 digits>             names the save of a version

The rows are written first and the commit file last. Of two writers that started from one version only
one can commit the next: the other is told so, and ``update_ledger`` folds its change into the
winner's ledger instead.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesync.model import LEDGER, select_as
from tablesync.session import local_frame, new_id
from tablesync.sources.commits import CommitConflict, commit, newest_commit


class LedgerConflict(RuntimeError):
    """Another writer saved the ledger since it was read."""


def ledger_path(root: str, pipeline: str) -> str:
    return f"{root.rstrip('/')}/{re.sub('[^A-Za-z0-9_-]', '-', pipeline)}.snapshot-checkpoints"


def ledger_version(spark: SparkSession, root: str, pipeline: str) -> int:
    """Number of the newest ledger; 0 when none was saved."""
    return newest_commit(spark, f"{ledger_path(root, pipeline)}/commits")[0]


def load_ledger(spark: SparkSession, root: str, pipeline: str) -> DataFrame:
    """The newest ledger; empty when none was saved. Blank pipeline names are filled in."""
    return load_version(spark, root, pipeline)[0]


def load_version(spark: SparkSession, root: str, pipeline: str) -> tuple[DataFrame, int]:
    """The newest ledger and its number."""
    path = ledger_path(root, pipeline)
    version, save = newest_commit(spark, f"{path}/commits")
    if save is None:
        return local_frame(spark, [], LEDGER), 0
    rows = spark.read.schema(LEDGER).parquet(f"{path}/rows/save={save}")
    name = F.when(F.coalesce("pipeline_name", F.lit("")) == "", F.lit(pipeline))
    return select_as(rows.withColumn("pipeline_name", name.otherwise(F.col("pipeline_name"))), LEDGER), version


def save_ledger(ledger: DataFrame, root: str, pipeline: str, based_on: int | None = None) -> DataFrame:
    """Write the next version as one file, commit it, and return it stored.

    ``based_on`` is the version the ledger was made from; if that is not the newest any more, or another
    writer commits at the same moment, nothing is saved and ``LedgerConflict`` is raised. A ledger
    has one row per table, so one file is enough.
    """
    spark, path = ledger.sparkSession, ledger_path(root, pipeline)
    newest = ledger_version(spark, root, pipeline)
    if based_on is not None and based_on != newest:
        raise LedgerConflict(f"ledger of {pipeline} is at version {newest}, not {based_on}")
    save = new_id()
    select_as(ledger, LEDGER).coalesce(1).write.parquet(f"{path}/rows/save={save}")
    try:
        commit(spark, f"{path}/commits", newest + 1, save)
    except CommitConflict:
        raise LedgerConflict(f"version {newest + 1} of the ledger of {pipeline} was saved by another writer") from None
    return load_ledger(spark, root, pipeline)


def update_ledger(
    spark: SparkSession, root: str, pipeline: str, change: Callable[[DataFrame], DataFrame], attempts: int = 20
) -> DataFrame:
    """Apply ``change`` to the newest ledger and save it; folded again if another writer was faster."""
    for attempt in range(1, attempts + 1):
        ledger, version = load_version(spark, root, pipeline)
        try:
            return save_ledger(change(ledger), root, pipeline, version)
        except LedgerConflict:
            if attempt == attempts:
                raise
    raise AssertionError
