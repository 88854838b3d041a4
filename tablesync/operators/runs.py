"""Run-history reports: metadata tables and event logs of many pipelines, as set operations."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablesync.operators.schema import verify_key

# States that end a run or a table execution.
RUN_FINISHED = ("succeeded", "failed", "error", "cancelled")
TABLE_FINISHED = ("staged", "applied", "failed", "snapshot_complete")
# Error kind, its code, and whether the event's own flag decides on a retry.
ERROR_KINDS = (
    ("connection_failed", "CONNECTION_FAILED", True),
    ("query_failed", "QUERY_FAILED", True),
    ("staging_failed", "STAGING_FAILED", True),
    ("validation_error", "VALIDATION_ERROR", False),
    ("not_found", "NOT_FOUND", False),
    ("internal", "INTERNAL_ERROR", False),
)


def pipelines_overview(pipelines: DataFrame, specs: DataFrame) -> DataFrame:
    """Pipelines by name with the version of their active spec, 0 without one."""
    active = specs.select(F.col("id").alias("active_spec_id"), "version")
    return (
        pipelines.join(active, "active_spec_id", "left")
        .select("name", "source_kind", "destination_kind", "status",
                F.coalesce("version", F.lit(0)).alias("spec_version"))
        .orderBy("name")
    )


def _named_runs(runs: DataFrame, pipelines: DataFrame) -> DataFrame:
    names = pipelines.select(F.col("id").alias("pipeline_id"), F.col("name").alias("pipeline_name"))
    return runs.join(names, "pipeline_id")


def _newest_first() -> list[Column]:
    return [F.desc("started_at"), F.desc("created_at"), F.desc("id")]


def run_list(runs: DataFrame, pipelines: DataFrame, name: str | None = None) -> DataFrame:
    """Runs, newest first; of one pipeline when ``name`` is given."""
    if name is not None:
        pipelines = pipelines.filter(F.col("name") == name)
    return _named_runs(runs, pipelines).orderBy(*_newest_first())


def run_history(runs: DataFrame, pipelines: DataFrame, n: int = 10) -> DataFrame:
    """The newest ``n`` runs of every pipeline, with their ``position`` from 1.

    Spark keeps ``n`` rows per pipeline and task before the shuffle.
    """
    newest = W.partitionBy("pipeline_id").orderBy(*_newest_first())
    top = runs.withColumn("position", F.row_number().over(newest)).filter(F.col("position") <= n)
    return _named_runs(top, pipelines)


def latest_run(runs: DataFrame, pipelines: DataFrame) -> DataFrame:
    return run_history(runs, pipelines, 1).drop("position")


def _last(column: str, *order: str) -> Column:
    return F.max_by(column, F.struct(*order))


def fold_run_status(events: DataFrame, order=("ts", "event_id")) -> DataFrame:
    """Current state of each run from its status events.

    The last event sets the status and the statistics, into which its ``phase`` and ``progress``
    are merged; the last event with a final status sets ``finished_at``. All of it is combined on
    the map side.
    """
    final = F.col("status").isin(*RUN_FINISHED)
    last = events.groupBy("run_id").agg(
        F.max_by(F.struct("status", *[c for c in _STATS if c in events.columns]), F.struct(*order))
        .alias("_e"),
        F.max(F.when(final, F.col(order[0]))).alias("finished_at"),
        F.max(order[0]).alias("updated_at"),
    )
    stats = _merged_stats([c for c in _STATS if c in events.columns])
    return last.select(
        "run_id", F.col("_e.status").alias("status"), "finished_at", "updated_at",
        stats.alias("stats_json"),
    )


_STATS = ("stats_json", "phase", "progress_current", "progress_total")


def _merged_stats(present) -> Column:
    """The stats object with ``phase`` and ``progress`` set where the event has them."""
    field = lambda c: F.col(f"_e.{c}") if c in present else F.lit(None)
    base = F.from_json(F.coalesce(field("stats_json").cast("string"), F.lit("{}")), "map<string,variant>")
    phase, current = field("phase").cast("string"), field("progress_current").cast("bigint")
    progress = F.to_json(
        F.struct(current.alias("current"), field("progress_total").cast("bigint").alias("total")),
        {"ignoreNullFields": "false"},
    )
    extra = F.filter(
        F.array(
            F.struct(F.lit("phase").alias("k"),
                     F.parse_json(F.to_json(F.array(phase))).alias("v"), phase.isNotNull().alias("u")),
            F.struct(F.lit("progress").alias("k"), F.parse_json(progress).alias("v"),
                     current.isNotNull().alias("u")),
        ),
        lambda e: e["u"],
    )
    unwrapped = F.transform(
        extra,
        lambda e: F.struct(
            e["k"].alias("key"),
            F.when(e["k"] == "phase", F.try_variant_get(e["v"], "$[0]", "variant"))
            .otherwise(e["v"]).alias("value"),
        ),
    )
    names = F.transform(extra, lambda e: e["k"])
    kept = F.map_filter(base, lambda k, _: ~F.array_contains(names, k))
    return F.to_json(F.map_concat(kept, F.map_from_entries(unwrapped)))


def fold_table_executions(events: DataFrame, order=("ts", "event_id")) -> DataFrame:
    """Current row of each (run, stream): the last event, not completed where it does not say so,
    finished at the last event with a final status."""
    carried = [c for c in events.columns if c not in ("run_id", "stream_name", *order)]
    final = F.col("status").isin(*TABLE_FINISHED)
    rows = events.groupBy("run_id", "stream_name").agg(
        F.max_by(F.struct(*carried), F.struct(*order)).alias("_e"),
        F.min(order[0]).alias("started_at"),
        F.max(F.when(final, F.col(order[0]))).alias("finished_at"),
        F.max(order[0]).alias("updated_at"),
    )
    columns = [
        (F.coalesce(F.col(f"_e.{c}"), F.lit(False)) if c == "checkpoint_completed"
         else F.col(f"_e.{c}")).alias(c)
        for c in carried
    ]
    return rows.select("run_id", "stream_name", *columns, "started_at", "finished_at", "updated_at")


def list_artifacts(artifacts: DataFrame, run_id=None) -> DataFrame:
    """Staged artifacts by stream, partition and sequence; of one run when given."""
    if run_id is not None:
        artifacts = artifacts.filter(F.col("pipeline_run_id") == run_id)
    return artifacts.orderBy("pipeline_run_id", "stream_name", "partition_key", "sequence")


def duplicate_artifacts(artifacts: DataFrame) -> DataFrame:
    """Artifacts that break either uniqueness rule: one per run and key, one per run, stream,
    partition and sequence."""
    by_key = verify_key(artifacts, ["pipeline_run_id", "object_key"])
    by_place = verify_key(artifacts, ["pipeline_run_id", "stream_name", "partition_key", "sequence"])
    columns = ("pipeline_run_id", "rule", "row_count")
    return by_key.withColumn("rule", F.lit("object_key")).select(*columns).unionByName(
        by_place.withColumn("rule", F.lit("sequence")).select(*columns)
    )


def list_table_executions(executions: DataFrame, run_id=None) -> DataFrame:
    if run_id is not None:
        executions = executions.filter(F.col("run_id") == run_id)
    return executions.orderBy("run_id", "stream_name")


# Least and most time segments the applies are cut into by default; their bounds reach the driver.
SEGMENTS = (64, 1024)


def spec_versions(applies: DataFrame, segments: int | None = None) -> DataFrame:
    """Spec history from ``(pipeline_name, applied_at, apply_id, spec_text)``.

    A text equal to the active one makes no new version; any other gets the next number, also
    when it equals an older spec. Versions follow from all earlier applies of the pipeline, so
    each pipeline's history is cut into time segments: changes are numbered within a segment,
    and the segments, a small table, add up what came before. No pipeline is one task's work.
    """
    if segments is None:
        partitions = int(applies.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        segments = min(max(partitions, SEGMENTS[0]), SEGMENTS[1])
    hashed = applies.withColumn("content_hash", F.sha2(F.col("spec_text").cast("binary"), 256))
    # Microseconds, so that a bound equals a value of the data.
    at = F.unix_micros(F.col("applied_at").cast("timestamp"))
    shares = [i / segments for i in range(1, segments)]
    bounds = applies.agg(F.percentile_approx(at, shares, 10_000)).first()[0] or []
    # The segment of a row is found by binary search; microseconds are exact as doubles until 2255.
    cuts = [-math.inf, *sorted({float(b) for b in bounds} or {0.0}), math.inf]
    bucketed = Bucketizer(splits=cuts, inputCol="_at", outputCol="_segment").transform(hashed.withColumn("_at", at.cast("double")))
    parts = bucketed.withColumn("_segment", F.col("_segment").cast("int")).drop("_at")

    order = ["applied_at", "apply_id"]
    inside = W.partitionBy("pipeline_name", "_segment").orderBy(*order)
    previous = F.lag("content_hash").over(inside)
    rows = parts.withColumn("_prev", previous)
    place = F.struct(*order)
    ends = parts.groupBy("pipeline_name", "_segment").agg(
        F.min_by("content_hash", place).alias("_first"), F.max_by("content_hash", place).alias("_end")
    )
    changes = rows.filter(F.col("_prev").isNotNull()).groupBy("pipeline_name", "_segment").agg(
        F.count_if(F.col("_prev") != F.col("content_hash")).alias("_inner")
    )
    across = W.partitionBy("pipeline_name").orderBy("_segment")
    before = across.rowsBetween(W.unboundedPreceding, -1)
    carried = F.lag("_end").over(across)
    starts = (
        ends.join(changes, ["pipeline_name", "_segment"], "left")
        .withColumn("_carried", carried)
        .withColumn("_opens", (~F.col("_first").eqNullSafe(F.col("_carried"))).cast("int"))
        .withColumn("_all", F.col("_opens") + F.coalesce("_inner", F.lit(0)))
        .withColumn("_before", F.coalesce(F.sum("_all").over(before), F.lit(0)))
        .select("pipeline_name", "_segment", "_carried", "_before")
    )
    joined = rows.join(starts, ["pipeline_name", "_segment"])
    active = F.coalesce("_prev", "_carried")
    changed = (~F.col("content_hash").eqNullSafe(active)).cast("int")
    return (
        joined.withColumn("_changed", changed)
        .withColumn("version", F.col("_before") + F.sum("_changed").over(
            inside.rowsBetween(W.unboundedPreceding, W.currentRow)))
        .select("pipeline_name", "apply_id", "applied_at", "content_hash", "version",
                (F.col("_changed") == 1).alias("new_version"))
    )


class PipelineNotFound(LookupError):
    """No pipeline has the given name."""


def drop_pipeline(
    name: str, pipelines: DataFrame, specs: DataFrame, runs: DataFrame, artifacts: DataFrame,
    executions: DataFrame,
) -> dict[str, DataFrame]:
    """All metadata tables without one pipeline and what belongs to it.

    Artifacts and executions of runs that no pipeline has stay as they are.
    """
    gone = pipelines.filter(F.col("name") == name).select(F.col("id").alias("pipeline_id"))
    if not gone.limit(1).collect():
        raise PipelineNotFound(name)
    gone_runs = runs.join(gone, "pipeline_id", "left_semi").select(F.col("id").alias("pipeline_run_id"))
    return {
        "pipelines": pipelines.filter(F.col("name") != name),
        "specs": specs.join(gone, "pipeline_id", "left_anti"),
        "runs": runs.join(gone, "pipeline_id", "left_anti"),
        "artifacts": artifacts.join(gone_runs, "pipeline_run_id", "left_anti"),
        "executions": executions.join(gone_runs, "pipeline_run_id", "left_anti"),
    }


def run_durations(runs: DataFrame) -> DataFrame:
    """Milliseconds from start to finish, null while running, and both display texts."""
    ms = F.unix_millis(F.col("finished_at").cast("timestamp")) - F.unix_millis(
        F.col("started_at").cast("timestamp")
    )
    half_up = lambda unit: F.floor(ms / unit + F.lit(0.5)).cast("string")
    text = (
        F.when(ms.isNull(), "—")
        .when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
        .when(ms < 60_000, F.concat(half_up(1000), F.lit("s")))
        .otherwise(F.concat(half_up(60_000), F.lit("m")))
    )
    out = runs.withColumns({"duration_ms": ms, "duration": text})
    if "rows_processed" not in runs.columns:
        return out
    done, total = F.format_number("rows_processed", 0), F.format_number("rows_total", 0)
    progress = F.when(
        F.col("rows_total").isNotNull(), F.concat(done, F.lit(" / "), total, F.lit(" rows"))
    ).otherwise(F.concat(done, F.lit(" rows")))
    return out.withColumn("row_progress", progress)


def classify_errors(events: DataFrame, kind: str = "error_kind", flag: str = "retryable"):
    """Machine-readable code of each error, and whether a retry may help."""
    code, may_retry = F.lit(None).cast("string"), F.lit(False)
    for name, text, flagged in ERROR_KINDS:
        code = F.when(F.col(kind) == name, text).otherwise(code)
        if flagged:
            may_retry = may_retry | (F.col(kind) == name)
    retry = may_retry & F.coalesce(flag, F.lit(False))
    return events.withColumns({"error_code": code, "is_retryable": F.coalesce(retry, F.lit(False))})
