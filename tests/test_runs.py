import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tablesync.operators import runs as R


def at(minute, second=0, ms=0):
    return dt.datetime(2024, 1, 1, 0, minute, second, ms * 1000)


@pytest.fixture
def pipelines(spark):
    return spark.createDataFrame(
        [(1, "b", "postgres", "postgres", "active", 10), (2, "a", "postgres", "s3", "paused", None)],
        "id int, name string, source_kind string, destination_kind string, status string, active_spec_id int",
    )


@pytest.fixture
def run_rows(spark):
    data = [(i, 1 + (i % 4 == 0), at(i % 7), at(i), "running") for i in range(20)]
    return spark.createDataFrame(data, "id int, pipeline_id int, started_at timestamp, created_at timestamp, status string")


def test_overview(spark, pipelines):
    specs = spark.createDataFrame([(10, 3)], "id int, version int")
    assert [(r.name, r.spec_version) for r in R.pipelines_overview(pipelines, specs).collect()] == [("a", 0), ("b", 3)]


def test_run_lists(run_rows, pipelines):
    listed = R.run_list(run_rows, pipelines, "b").collect()
    keys = [(r.started_at, r.created_at) for r in listed]
    assert len(listed) == 15 and keys == sorted(keys, reverse=True)
    history = R.run_history(run_rows, pipelines).collect()
    assert sum(r.pipeline_name == "b" for r in history) == 10 and sum(r.pipeline_name == "a" for r in history) == 5
    latest = {r.pipeline_name: r.id for r in R.latest_run(run_rows, pipelines).collect()}
    assert latest == {"b": listed[0].id, "a": R.run_list(run_rows, pipelines, "a").first().id}


def test_fold_run_status(spark):
    log = spark.createDataFrame(
        [
            ("r1", at(1), 1, "running", '{"rows": 5, "phase": "old"}', "extract", 1, 10),
            ("r1", at(2), 2, "succeeded", '{"rows": 9, "phase": "old", "x": [1, "a"]}', "load", 10, None),
            ("r2", at(1), 3, "failed", None, None, None, None),
            ("r2", at(3), 4, "running", '{"a": 1}', None, None, None),
        ],
        "run_id string, ts timestamp, event_id int, status string, stats_json string, phase string, "
        "progress_current bigint, progress_total bigint",
    )
    out = {r.run_id: r for r in R.fold_run_status(log).collect()}
    assert (out["r1"].status, out["r1"].finished_at) == ("succeeded", at(2))
    assert json.loads(out["r1"].stats_json) == {
        "rows": 9, "x": [1, "a"], "phase": "load", "progress": {"current": 10, "total": None}
    }
    assert (out["r2"].status, out["r2"].finished_at) == ("running", at(1))
    assert json.loads(out["r2"].stats_json) == {"a": 1}
    bare = R.fold_run_status(log.select("run_id", "ts", "event_id", "status")).first()
    assert bare.stats_json == "{}"


def test_fold_table_executions(spark):
    log = spark.createDataFrame(
        [("r", "a", at(1), 1, "snapshot_running", 5, True), ("r", "a", at(2), 2, "snapshot_complete", 9, None),
         ("r", "b", at(1), 3, "running", 1, None)],
        "run_id string, stream_name string, ts timestamp, event_id int, status string, rows_processed bigint, checkpoint_completed boolean",
    )
    a, b = R.list_table_executions(R.fold_table_executions(log), "r").collect()
    assert (a.status, a.rows_processed, a.finished_at, a.checkpoint_completed) == ("snapshot_complete", 9, at(2), False)
    assert (b.stream_name, b.finished_at) == ("b", None)


def test_artifacts(spark):
    rows = spark.createDataFrame(
        [(1, "b", "default", 0, "k1"), (1, "a", "default", 1, "k2"), (1, "a", "default", 0, "k2"), (2, "a", "default", 0, "k")],
        "pipeline_run_id int, stream_name string, partition_key string, sequence int, object_key string",
    )
    assert [(r.stream_name, r.sequence) for r in R.list_artifacts(rows, 1).collect()] == [("a", 0), ("a", 1), ("b", 0)]
    assert [tuple(r) for r in R.duplicate_artifacts(rows).collect()] == [(1, "object_key", 2)]


def test_spec_versions_small(spark):
    data = [("p", at(i), i, t) for i, t in enumerate("AABBACC")] + [("q", at(1), 90, "A")]
    out = R.spec_versions(spark.createDataFrame(data, "pipeline_name string, applied_at timestamp, apply_id int, spec_text string"))
    got = [(r.version, r.new_version) for r in out.filter("pipeline_name = 'p'").orderBy("apply_id").collect()]
    assert got == [(1, True), (1, False), (2, True), (2, False), (3, True), (4, True), (4, False)]
    assert out.filter("pipeline_name = 'q'").first().version == 1
    assert out.first().content_hash.__len__() == 64


def test_spec_versions_equal_one_long_window(spark):
    """Against the plain window, with one pipeline holding most applies and equal times."""
    applies = spark.range(4000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 5)).alias("pipeline_name"),
        F.timestamp_seconds(F.col("id") * 7919 % 1000).alias("applied_at"), F.col("id").alias("apply_id"),
        (F.xxhash64("id") % 3).cast("string").alias("spec_text"),
    )
    for segments in (1, 7, 64):
        out = R.spec_versions(applies, segments)
        w = W.partitionBy("pipeline_name").orderBy("applied_at", "apply_id")
        changed = (~F.col("spec_text").eqNullSafe(F.lag("spec_text").over(w))).cast("int")
        want = applies.withColumn("c", changed).withColumn("version", F.sum("c").over(w)).select("apply_id", "version")
        assert out.select("apply_id", "version").exceptAll(want).count() == 0 and out.count() == 4000
    assert R.spec_versions(applies.limit(0)).count() == 0


def test_drop_pipeline(spark, pipelines, run_rows):
    specs = spark.createDataFrame([(1, 1), (2, 1)], "pipeline_id int, version int")
    art = run_rows.select(F.col("id").alias("pipeline_run_id"))
    left = R.drop_pipeline("a", pipelines, specs, run_rows, art, art)
    assert {k: v.count() for k, v in left.items()} == {"pipelines": 1, "specs": 1, "runs": 15, "artifacts": 15, "executions": 15}
    with pytest.raises(R.PipelineNotFound):
        R.drop_pipeline("zz", pipelines, specs, run_rows, art, art)


def test_durations(spark):
    data = [(at(1), None, 5, None), (at(1), at(1, 0, 999), 1234, 5678), (at(1), at(1, 2, 500), 0, 0), (at(1), at(3, 30), 1, None)]
    out = R.run_durations(spark.createDataFrame(data, "started_at timestamp, finished_at timestamp, rows_processed bigint, rows_total bigint")).collect()
    assert [(r.duration_ms, r.duration) for r in out] == [(None, "—"), (999, "999ms"), (2500, "3s"), (150000, "3m")]
    assert [r.row_progress for r in out] == ["5 rows", "1,234 / 5,678 rows", "0 / 0 rows", "1 rows"]


def test_classify_errors(spark):
    data = [("connection_failed", True), ("connection_failed", False), ("query_failed", None), ("staging_failed", True),
            ("validation_error", True), ("not_found", True), ("internal", True), ("strange", True)]
    out = R.classify_errors(spark.createDataFrame(data, "error_kind string, retryable boolean")).collect()
    assert [(r.error_code, r.is_retryable) for r in out] == [
        ("CONNECTION_FAILED", True), ("CONNECTION_FAILED", False), ("QUERY_FAILED", False), ("STAGING_FAILED", True),
        ("VALIDATION_ERROR", False), ("NOT_FOUND", False), ("INTERNAL_ERROR", False), (None, False)]
