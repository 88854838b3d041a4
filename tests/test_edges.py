"""Cases in which results used to go wrong: strict JSON, ties, cursors, restaged keys, change logs."""

import gzip

import pytest
from pyspark.sql import functions as F

from tablesync.functions import codec
from tablesync.functions.codec import project_typed
from tablesync.model import LEDGER, PROGRESS, REPORT
from tablesync.operators import cdc, chunking
from tablesync.operators import checkpoint as cp
from tablesync.operators.load import ChunkConflict
from tablesync.plans.jobs import Capture, load_staging, replicate, snapshot_to_staging
from tablesync.plans.run_log import RunLog
from tablesync.session import local_frame
from tablesync.sources import capture, jdbc, staged
from tablesync.sources.keyed_table import KeyedTable
from tablesync.sources.raw_store import RawStore
from tablesync.sources.staged import Staging, read_chunks, read_manifest, read_staged
from tablesync.streaming.changes import apply_changes, backfill, cdc_stream, cdc_table
from tablesync.streaming.loader import stream_load
from tests_helpers import stage_rows


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


@pytest.mark.parametrize("value", ['{"a":1}', ' {"a":1} ', "3", "null", '"x"', "[1,2]", '{"a":1,"a":2}', '{"a":[1,{"b":null}]}'])
def test_valid_lines_pass(spark, value):
    row = lines(spark, value).select(codec.checked_json(F.col("value")).alias("v")).first()
    assert row.v == value


@pytest.mark.parametrize("value", ['{"a":1} x', '{"a":1}{"b":2}', '{"a":1},{"b":2}', '{"a":', "{a}", '{"a":1', "x", ""])
def test_malformed_lines_fail(spark, value):
    with pytest.raises(Exception, match="invalid staged JSON"):
        lines(spark, value).select(codec.checked_json(F.col("value"))).collect()


def test_wide_lines_decode(spark):
    wide = spark.range(1).select("id", F.repeat(F.lit("é,\"x"), 6_000_000).alias("text"))
    record = codec.encode_rows(wide)
    checked = record.select(codec.checked_json(F.col("record")).alias("record"))
    out = project_typed(checked, wide.schema, "record").select("id", F.length("text").alias("n"), F.md5("text").alias("h")).first()
    want = wide.select(F.length("text").alias("n"), F.md5("text").alias("h")).first()
    assert (out.id, out.n, out.h) == (0, want.n, want.h)


def test_embedded_json_keeps_lines_whole(spark):
    df = spark.createDataFrame([(1, '{"a":\n 1}', "x"), (2, None, "y")], "id int, doc string, t string")
    rows = [r.record for r in codec.encode_rows(df, json_columns=["doc"]).collect()]
    assert rows == ['{"id":1,"doc":{"a":  1},"t":"x"}', '{"id":2,"doc":null,"t":"y"}']


def test_tied_rows_come_out_alike_at_every_size(spark, monkeypatch):
    df = spark.range(400).select((F.col("id") % 10).alias("k"), "id").repartition(7)
    few = sorted(tuple(r) for r in capture.capture_bounded(df, "k", 65).collect())
    monkeypatch.setattr(capture, "TOP_K_ROWS", 10)
    assert sorted(tuple(r) for r in capture.capture_bounded(df, "k", 65).collect()) == few


def test_file_numbering_moves_no_rows(spark, tmp_path):
    spark.range(100).repartition(5).write.parquet(str(tmp_path / "t"))
    numbered = chunking.number_files(spark, str(tmp_path / "t"))
    assert sorted(r[0] for r in numbered.df.select(chunking.INDEX).collect()) == list(range(100))


def ledger(spark, cursor, kind):
    return local_frame(spark, [("p", "a.b", 3, 10, None, False, 0, cursor, kind, None)], LEDGER)


@pytest.mark.parametrize("old, new, kind, want", [
    ("100", "95", "bigint", "100"), ("100", "105", "bigint", "105"), ("9", "10", "int", "10"), ("100", None, "bigint", "100"),
    ("9007199254740993", "9007199254740992", "bigint", "9007199254740993"), ("1.50", "1.5000001", "decimal(20,7)", "1.5000001"),
    ("2.5e1", "3", "double", "2.5e1"), ("2024-02-01 00:00:00", "2023-12-31 23:59:59", "timestamp_ntz", "2024-02-01 00:00:00"),
    ("1700000000000001", "1700000000000000", "timestamp", "1700000000000001"), ("b", "a", "string", "b"), ("7", "3", None, "3"),
])
def test_cursor_never_moves_back(spark, old, new, kind, want):
    progress = local_frame(spark, [("a.b", 4, True, 5, new, kind, None)], PROGRESS)
    assert cp.apply_progress(ledger(spark, old, kind), progress, "p").first().last_cursor_value == want
    cursors = local_frame(spark, [("p", "a.b", new)], "pipeline_name string, table_name string, cursor_value string")
    assert cp.update_cursor(ledger(spark, old, kind), cursors).first().last_cursor_value == want


def test_capped_runs_with_overlap_advance(spark, tmp_path):
    rows = spark.range(1, 121).withColumn("v", F.col("id") * 2)
    staging, store = Staging(str(tmp_path / "s"), "shop"), RawStore(str(tmp_path / "raw"))
    for _ in range(4):
        replicate(spark, {"a.b": rows}, staging, store, Capture("incremental", 10, 40, "id", 20), str(tmp_path / "l"))
    got = project_typed(store.read(spark, "a.b"), rows.schema).distinct()
    assert got.count() == 120


def test_restaged_keys(spark, tmp_path):
    staging, store = Staging(str(tmp_path / "s"), "shop"), RawStore(str(tmp_path / "raw"))
    for run in ("r1", "r2"):
        stage_rows(spark, staging, spark.range(10), 4, run)
    stream_load(spark, staging, store, str(tmp_path / "p")).awaitTermination()
    assert store.read(spark).count() == 10
    other, clash = RawStore(str(tmp_path / "raw2")), Staging(str(tmp_path / "s2"), "shop")
    stage_rows(spark, clash, spark.range(10), 4, "r1")
    stage_rows(spark, clash, spark.range(5, 15), 4, "r2")
    with pytest.raises(Exception, match="unlike content"):
        stream_load(spark, clash, other, str(tmp_path / "p2")).awaitTermination()
    stream_load(spark, clash, other, str(tmp_path / "p3"), replace=True).awaitTermination()
    ids = project_typed(other.read(spark), spark.range(1).schema)
    assert sorted(r[0] for r in ids.collect()) == list(range(5, 15))
    assert issubclass(ChunkConflict, Exception)


CHANGE = "op string, lsn bigint, id int, v string"


@pytest.mark.parametrize("op", [None, "d", "X"])
def test_unknown_operations_fail(spark, tmp_path, op):
    snapshot = spark.createDataFrame([(1, "a")], "id int, v string")
    bad = spark.createDataFrame([(op, 11, 1, "b")], CHANGE)
    with pytest.raises(Exception, match="unknown change operation"):
        cdc.cdc_apply(snapshot, bad, "id", 10).collect()
    table = cdc_table(str(tmp_path / "t"), "id", snapshot.schema, 2)
    with pytest.raises(Exception, match="unknown change operation"):
        apply_changes(table, bad)


def test_stream_equals_batch_below_the_snapshot(spark, tmp_path):
    snapshot = spark.createDataFrame([(1, "a")], "id int, v string")
    spark.createDataFrame([("I", 5, 9, "old"), ("U", 10, 1, "same"), ("U", 11, 1, "b"), ("I", 12, 4, "new")], CHANGE).write.parquet(str(tmp_path / "log"))
    log = spark.readStream.schema(CHANGE).parquet(str(tmp_path / "log"))
    table = cdc_table(str(tmp_path / "t"), "id", snapshot.schema, 2)
    cdc_stream(log, table, str(tmp_path / "p"), "full", snapshot, 10).awaitTermination()
    want = sorted(tuple(r) for r in cdc.cdc_apply(snapshot, spark.read.schema(CHANGE).parquet(str(tmp_path / "log")), "id", 10).collect())
    seen = lambda: sorted(tuple(r)[:2] for r in table.read(spark).collect())
    assert seen() == want == [(1, "b"), (4, "new")]
    assert backfill(table, snapshot, 10) is False and seen() == want


def test_bucket_count_is_kept(spark, tmp_path):
    rows = spark.range(50).withColumn("v", F.lit(1))
    table = KeyedTable(str(tmp_path / "t"), ("id",), rows.schema, 4)
    table.replace(rows)
    with pytest.raises(ValueError, match="4 buckets, not 8"):
        KeyedTable(str(tmp_path / "t"), ("id",), rows.schema, 8).read(spark)
    wide = table.rebucket(spark, 8)
    wide.upsert(spark.range(3).withColumn("v", F.lit(2)), "v")
    assert wide.read(spark).count() == 50 and wide.read(spark).filter("v = 2").count() == 3


def test_read_staged_belongs_to_the_session(spark, tmp_path):
    staging = Staging(str(tmp_path / "s"), "shop")
    stage_rows(spark, staging, spark.range(10), 4, "r1")
    spark.conf.set("spark.sql.files.maxPartitionNum", "1")
    try:
        read_staged(spark, staging).createOrReplaceTempView("staged_lines")
        assert spark.sql("SELECT count(DISTINCT _row_number, sequence) AS n FROM staged_lines").first().n == 10
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionNum")
        spark.catalog.dropTempView("staged_lines")


def test_whole_capture_leaves_no_scratch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(chunking, "number_rows", None)
    staging = Staging(str(tmp_path / "s"), "shop")
    staged = snapshot_to_staging(spark, {"a.b": spark.range(30)}, staging, Capture(keys={"a.b": ["id"]}), local_frame(spark, [], LEDGER))
    progress = staged.progress.first()
    assert (progress.rows_emitted, progress.next_sequence, progress.last_key) == (30, 1, '{"id":"29"}')
    empty = snapshot_to_staging(spark, {"a.c": spark.range(0)}, staging, Capture(), local_frame(spark, [], LEDGER))
    assert empty.manifest.first().row_count == 0


def test_failed_runs_are_recorded(spark, tmp_path):
    log, staging = RunLog(str(tmp_path / "log")), Staging(str(tmp_path / "s"), "shop")
    bad = spark.range(3).select(F.raise_error(F.lit("boom")).cast("string").alias("id"))
    with pytest.raises(Exception, match="boom"):
        replicate(spark, {"a.b": bad}, staging, RawStore(str(tmp_path / "r")), Capture(), str(tmp_path / "l"), log=log)
    states = [r.status for r in log.read(spark, "status").orderBy("event_id").collect()]
    assert states == ["running", "failed"] and "boom" in log.read(spark, "status").filter("status = 'failed'").first().stats_json


def test_foreign_chunks_are_digested_once(spark, tmp_path, monkeypatch):
    staging, store = Staging(str(tmp_path / "s"), "shop"), RawStore(str(tmp_path / "raw"))
    folder = tmp_path / "s/staging/pipelines/shop/streams/public.t/partitions/default/chunks"
    folder.mkdir(parents=True)

    def put(number, values):
        with gzip.open(folder / f"{number:020d}.jsonl.gz", "wt") as f:
            f.write("".join(f'{{"id":{v}}}\n' for v in values))

    read = []
    original = staged._foreign_lines
    monkeypatch.setattr(staged, "_foreign_lines", lambda s, paths: read.append(len(paths)) or original(s, paths))
    put(0, range(4))
    put(1, range(4, 6))
    assert sorted(r.rows_written for r in load_staging(spark, staging, store).collect()) == [2, 4]
    read.clear()
    assert [r.skipped for r in load_staging(spark, staging, store).collect()] == [True, True] and read == []
    put(2, range(6, 9))
    load_staging(spark, staging, store).collect()
    assert read == [1, 1]  # the new file is digested, then loaded
    ids = project_typed(store.read(spark), spark.range(1).schema)
    assert sorted(r[0] for r in ids.collect()) == list(range(9))


def test_jdbc_load_over_folders(spark, tmp_path):
    """Reader and writer stand in for the database: a first load, a second, and rows written twice."""
    staging = Staging(str(tmp_path / "s"), "shop")
    stage_rows(spark, staging, spark.range(10), 4, "r1")
    folder = lambda name: str(tmp_path / name.replace('"', "").replace(".", "-"))
    reader = lambda name: spark.read.parquet(folder(name))

    def writer(rows, name):
        for _ in range(2 if "applied" not in name else 1):  # a task that is tried twice
            rows.write.mode("append").parquet(folder(name))

    def load():
        chunks = read_manifest(spark, staging, all_attempts=False)
        out = jdbc.load_jdbc(chunks, lambda c: read_chunks(spark, staging, c), "jdbc:x", reader=reader, writer=writer)
        assert out.columns == [f.name for f in REPORT]
        return sorted((r.rows_written, r.skipped) for r in out.collect())

    assert load() == [(2, False), (4, False), (4, False)]
    assert load() == [(0, True)] * 3
