import pytest
from pyspark.sql import functions as F

from tablesync.functions.codec import project_typed
from tablesync.operators.load import ChunkConflict, load_totals, select_unapplied
from tablesync.operators.reconcile import reconcile_rows
from tablesync.sources.raw_store import RawStore
from tablesync.sources.staged import Staging, read_chunks, read_manifest
from tests_helpers import stage_rows


@pytest.fixture
def area(spark, tmp_path):
    return Staging(str(tmp_path / "staging"), "shop"), RawStore(str(tmp_path / "raw"))


def load(spark, staging, store, replace=False):
    chunks = read_manifest(spark, staging, all_attempts=False)
    return store.load(chunks, lambda c: read_chunks(spark, staging, c), replace)


def test_each_chunk_is_loaded_once(spark, area):
    staging, store = area
    stage_rows(spark, staging, spark.range(25), 10, "r1")
    first = load(spark, staging, store).collect()
    assert sorted(r.rows_written for r in first) == [5, 10, 10] and not any(r.skipped for r in first)
    assert {r.table_name for r in first} == {'"tablesync_raw"."raw_public_t"'}
    again = load(spark, staging, store)
    assert [(r.rows_written, r.skipped) for r in again.collect()] == [(0, True)] * 3
    assert load_totals(again).first() == (0, 0, 3)
    rows = store.read(spark, "public.t")
    assert rows.count() == 25 and store.applied(spark).count() == 3
    assert select_unapplied(read_manifest(spark, staging), store.applied(spark)).count() == 0


def test_decoded_count_corrects_the_manifest(spark, area):
    staging, store = area
    chunks = stage_rows(spark, staging, spark.range(5), 10, "r1").withColumn("row_count", F.lit(999).cast("bigint"))
    store.load(chunks, lambda c: read_chunks(spark, staging, c))
    assert [r.row_count for r in store.applied(spark).collect()] == [5]


def test_crash_before_the_commit_leaves_nothing_visible(spark, area, monkeypatch):
    staging, store = area
    df = spark.range(25)
    stage_rows(spark, staging, df, 10, "r1")

    def crash(*_a, **_k):
        raise RuntimeError("killed")

    for step in ("write_applied", "commit"):
        with monkeypatch.context() as m:
            m.setattr(RawStore, step, crash)
            with pytest.raises(RuntimeError):
                load(spark, staging, store)
        assert store.read(spark).count() == 0 and store.applied(spark).count() == 0
    assert load_totals(load(spark, staging, store)).first()[:2] == (3, 25)
    loaded = project_typed(store.read(spark, "public.t"), df.schema)
    assert reconcile_rows(df, loaded, "id").count() == 0


def test_same_key_with_other_content(spark, area):
    staging, store = area
    stage_rows(spark, staging, spark.range(5), 5, "r1")
    stage_rows(spark, staging, spark.range(50, 53), 5, "r1", stream="public.other")
    load(spark, staging, store)
    stage_rows(spark, staging, spark.range(100, 107), 5, "r2")
    with pytest.raises(ChunkConflict):
        load(spark, staging, store)
    assert store.read(spark, "public.t").count() == 5
    report = load(spark, staging, store, replace=True)
    assert load_totals(report).first() == (2, 7, 1)
    values = sorted(r[0] for r in store.read(spark, "public.t").select(F.get_json_object("_data", "$.id")).collect())
    assert values == [str(i) for i in range(100, 107)]
    assert store.read(spark, "public.other").count() == 3
    assert load_totals(load(spark, staging, store)).first() == (0, 0, 3)


def test_restaged_equal_content_is_skipped(spark, area):
    staging, store = area
    stage_rows(spark, staging, spark.range(5), 5, "r1")
    load(spark, staging, store)
    stage_rows(spark, staging, spark.range(5), 5, "r2")
    assert load_totals(load(spark, staging, store)).first() == (0, 0, 1)


def test_two_streams_with_one_raw_name(spark, area):
    staging, store = area
    stage_rows(spark, staging, spark.range(5), 5, "r1", stream="a.b_c")
    load(spark, staging, store)
    stage_rows(spark, staging, spark.range(5), 5, "r2", stream="a_b.c")
    with pytest.raises(ValueError, match="same raw table"):
        load(spark, staging, store)


def test_malformed_line_fails_the_load(spark, area):
    staging, store = area
    lines = spark.createDataFrame([("public.t", "default", 0, "{bad")], "stream_name string, partition_key string, sequence bigint, value string")
    lines.write.partitionBy("stream_name", "partition_key", "sequence").option("compression", "gzip").text(staging.attempt("r1"))
    from tablesync.sources.staged import chunk_manifest, commit_manifest

    commit_manifest(chunk_manifest(spark, staging, ["r1"]), staging, "r1")
    with pytest.raises(Exception, match="invalid staged JSON"):
        load(spark, staging, store)
    assert store.read(spark).count() == 0


def test_many_loads_use_a_join(spark, area, monkeypatch):
    from tablesync.sources import raw_store

    staging, store = area
    for i in range(3):
        stage_rows(spark, staging, spark.range(i, i + 2), 5, f"r{i}", stream=f"a.t{i}")
        load(spark, staging, store)
    monkeypatch.setattr(raw_store, "LISTED_LOADS", 1)
    assert store.read(spark).count() == 6 and store.applied(spark).count() == 3


def test_batch_size_bounds_the_files(spark, tmp_path):
    staging = Staging(str(tmp_path / "s"), "shop")
    store = RawStore(str(tmp_path / "raw"), batch_size=4)
    stage_rows(spark, staging, spark.range(25), 25, "r1")
    load(spark, staging, store)
    assert len(store.read(spark).inputFiles()) == 7 and store.read(spark).count() == 25
    with pytest.raises(ValueError):
        RawStore("x", batch_size=0)
