import pytest
from pyspark.sql import functions as F

from tablesync.functions.codec import project_typed
from tablesync.operators.cdc import cdc_apply
from tablesync.sources.raw_store import RawStore
from tablesync.sources.staged import Staging
from tablesync.streaming.changes import apply_changes, backfill, cdc_stream, cdc_table
from tablesync.plans.jobs import load_staging
from tablesync.streaming import loader
from tablesync.streaming.loader import stream_foreign_load, stream_load
from tests_helpers import stage_rows


def test_stream_loads_each_chunk_once(spark, tmp_path):
    staging, store = Staging(str(tmp_path / "s"), "sh:op +%"), RawStore(str(tmp_path / "raw"))
    progress = str(tmp_path / "progress")

    def go():
        query = stream_load(spark, staging, store, progress)
        query.awaitTermination()
        assert query.exception() is None

    stage_rows(spark, staging, spark.range(10), 4, "r1")
    go()
    go()
    assert store.read(spark).count() == 10
    stage_rows(spark, staging, spark.range(100, 105), 4, "r2", stream="public.other")
    go()
    ids = project_typed(store.read(spark), spark.range(1).schema)
    assert sorted(r[0] for r in ids.collect()) == [*range(10), *range(100, 105)]


def test_replayed_batch_adds_nothing(spark, tmp_path):
    """The stream's own progress is lost after a finished load."""
    staging, store = Staging(str(tmp_path / "s"), "shop"), RawStore(str(tmp_path / "raw"))
    stage_rows(spark, staging, spark.range(10), 4, "r1")
    for folder in ("p1", "p2"):
        stream_load(spark, staging, store, str(tmp_path / folder)).awaitTermination()
    assert store.read(spark).count() == 10


CHANGES = [
    ("U", 11, 1, "n"), ("D", 12, 2, None), ("I", 13, 8, "i"), ("U", 5, 3, "old"), ("D", 14, 77, None),
    ("U", 15, 1, "m"), ("I", 16, 2, "again"),
]


@pytest.fixture
def snapshot(spark):
    return spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string")


def changes(spark, rows):
    return spark.createDataFrame(rows, "op string, lsn bigint, id int, v string")


def visible(table, spark):
    return sorted(tuple(r)[:2] for r in table.read(spark).collect())


def test_changes_in_any_order_and_twice(spark, tmp_path, snapshot):
    want = sorted(map(tuple, cdc_apply(snapshot, changes(spark, CHANGES), "id", 10).collect()))
    for n, batches in enumerate(([CHANGES], [CHANGES[:3], CHANGES[3:]], [CHANGES[4:], CHANGES[:4]], [CHANGES, CHANGES[:3]])):
        table = cdc_table(str(tmp_path / f"t{n}"), "id", snapshot.schema, 4)
        backfill(table, snapshot, 10)
        for batch in batches:
            apply_changes(table, changes(spark, batch))
        assert visible(table, spark) == want


def test_late_snapshot_does_not_undo_changes(spark, tmp_path, snapshot):
    table = cdc_table(str(tmp_path / "t"), "id", snapshot.schema, 4)
    apply_changes(table, changes(spark, CHANGES))
    backfill(table, snapshot, 10)
    want = sorted(map(tuple, cdc_apply(snapshot, changes(spark, CHANGES), "id", 10).collect()))
    assert visible(table, spark) == want


def test_stream(spark, tmp_path, snapshot):
    log, progress = str(tmp_path / "log"), str(tmp_path / "progress")
    table = cdc_table(str(tmp_path / "t"), "id", snapshot.schema, 4)
    changes(spark, CHANGES[:3]).coalesce(1).write.parquet(log)
    stream = spark.readStream.schema(changes(spark, CHANGES).schema).parquet(log)
    cdc_stream(stream, table, progress, "full", snapshot, 10).awaitTermination()
    changes(spark, CHANGES[3:]).coalesce(1).write.mode("append").parquet(log)
    for _ in range(2):
        cdc_stream(stream, table, progress).awaitTermination()
    want = sorted(map(tuple, cdc_apply(snapshot, changes(spark, CHANGES), "id", 10).collect()))
    assert visible(table, spark) == want
    assert cdc_stream(None, table, progress) is None


def test_deleted_keys_are_hidden(spark, tmp_path, snapshot):
    table = cdc_table(str(tmp_path / "t"), "id", snapshot.schema, 2)
    backfill(table, snapshot, 1)
    apply_changes(table, changes(spark, [("D", 2, 1, None)]))
    apply_changes(table, changes(spark, [("U", 1, 1, "late")]))
    assert visible(table, spark) == [(2, "b"), (3, "c")]
    assert table.read(spark, raw=True).filter(F.col("_deleted")).count() == 1


def test_foreign_chunks_arrive_as_a_stream(spark, tmp_path, monkeypatch):
    """Chunks of another tool: blank lines, an empty file, a restart, lost progress, a rewritten key, a later batch load."""
    from test_staging import foreign

    staging, store = Staging(str(tmp_path / "s"), "shop", prefix="x"), RawStore(str(tmp_path / "raw"))
    digested = []
    original = loader.summarize_lines
    monkeypatch.setattr(loader, "summarize_lines", lambda rows, *keys: digested.append(1) or original(rows, *keys))

    def go(progress="p1", **options):
        stream_foreign_load(spark, staging, store, str(tmp_path / progress), **options).awaitTermination()
        return sorted((r._object_key[-10:-9], r._row_number, r._data) for r in store.read(spark).collect())

    foreign(staging, "public.u", 0, '{"id":1}\n\n  {"id":2}\r\n{"id":3}')
    foreign(staging, "public.empty", 0, "")
    foreign(staging, "public.u", "notes.txt", "ignored")
    first = [("0", 1, '{"id":1}'), ("0", 2, '{"id":2}'), ("0", 3, '{"id":3}')]
    assert go() == first and len(digested) == 1
    assert go() == first and len(digested) == 1  # nothing new, nothing read
    foreign(staging, "public.u", 1, '{"id":4}\n')
    foreign(staging, "public.v", 2, '{"id":5}\n')
    both = [*first, ("1", 1, '{"id":4}'), ("2", 1, '{"id":5}')]
    assert go(max_files_per_batch=1) == both and len(digested) == 3
    assert go("p2") == both  # the stream's own progress is lost
    report = load_staging(spark, staging, store).collect()
    assert report and all(r.skipped for r in report if r.rows_written or r.skipped)
    assert go() == both


def test_foreign_stream_refuses_other_content_and_bad_lines(spark, tmp_path):
    from test_staging import foreign

    staging, store = Staging(str(tmp_path / "s"), "shop"), RawStore(str(tmp_path / "raw"))
    foreign(staging, "public.u", 0, '{"id":1}\n')
    stream_foreign_load(spark, staging, store, str(tmp_path / "p1")).awaitTermination()
    foreign(staging, "public.u", 0, '{"id":2}\n')
    with pytest.raises(Exception, match="content"):
        stream_foreign_load(spark, staging, store, str(tmp_path / "p2")).awaitTermination()
    stream_foreign_load(spark, staging, store, str(tmp_path / "p2"), replace=True).awaitTermination()
    assert [r._data for r in store.read(spark).collect()] == ['{"id":2}']
    foreign(staging, "public.u", 1, '{"id":3}]\n')
    with pytest.raises(Exception, match="invalid staged JSON"):
        stream_foreign_load(spark, staging, store, str(tmp_path / "p2")).awaitTermination()
    assert store.read(spark).count() == 1
