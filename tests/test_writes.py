import pytest
from pyspark.sql import functions as F

from tablesync.operators import cdc, reconcile, writes
from tablesync.sources.keyed_table import KeyedTable


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def target(spark):
    return spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string")


@pytest.fixture
def updates(spark):
    data = [(2, "old", 1, "U"), (2, "new", 5, "U"), (4, "d", 2, "I"), (3, "x", 1, "U"), (3, "x", 9, "D"), (9, "z", 1, "D")]
    return spark.createDataFrame(data, "id int, v string, ts int, op string")


def test_modes(target, updates):
    assert rows(writes.write_append(target, target)) == sorted(rows(target) * 2)
    assert rows(writes.write_upsert(target, updates, "id", "ts")) == [(1, "a"), (2, "new"), (3, "x"), (4, "d"), (9, "z")]
    assert rows(writes.write_merge(target, updates, ["id"], ["ts"])) == [(1, "a"), (2, "new"), (4, "d")]
    assert rows(writes.write_replace(target, updates)) == rows(updates.select("id", "v"))


def test_latest_by_key_ties_are_stable(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, None, "c"), (2, None, "d")], "k int, t int, v string")
    first = rows(writes.latest_by_key(df, "k", "t"))
    assert len(first) == 2 and first == rows(writes.latest_by_key(df.orderBy(F.desc("v")), "k", "t"))


def test_hot_key_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 400, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("t"))
    out = writes.latest_by_key(df, "k", "t")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan
    assert out.filter("k = 0").first().t == 399 and out.count() == 601


def test_keyed_table(spark, tmp_path, target, updates):
    stored = KeyedTable(str(tmp_path / "k"), ("id",), target.schema, 4, 2)
    assert stored.read(spark).count() == 0
    stored.replace(target)
    stored.merge(updates, "ts")
    assert rows(stored.read(spark)) == [(1, "a"), (2, "new"), (4, "d")]
    stored.upsert(updates.filter("op = 'I'").withColumn("v", F.lit("dd")), "ts")
    stored.append(spark.createDataFrame([(7, "q")], target.schema))
    assert rows(stored.read(spark)) == [(1, "a"), (2, "new"), (4, "dd"), (7, "q")]
    deletes = stored.read(spark).select("id", "v", F.lit(1).alias("ts"), F.lit("D").alias("op"))
    stored.merge(deletes, "ts")
    assert stored.read(spark).count() == 0
    stored.replace(target.limit(0))
    assert stored.read(spark).count() == 0


def test_change_rewrites_touched_buckets_only(spark, tmp_path):
    df = spark.range(200).select("id", F.lit("a").alias("v"))
    stored = KeyedTable(str(tmp_path / "k"), ("id",), df.schema, 8)
    stored.replace(df)
    before, _ = stored._mapping(spark)
    stored.upsert(spark.createDataFrame([(3, "b", 1)], "id bigint, v string, ts int"), "ts")
    after, _ = stored._mapping(spark)
    assert sum(before[b] != after[b] for b in before) == 1
    assert stored.read(spark).count() == 200 and stored.read(spark).filter("v = 'b'").count() == 1


def test_crashed_change_leaves_the_table_as_it_was(spark, tmp_path, target, updates, monkeypatch):
    stored = KeyedTable(str(tmp_path / "k"), ("id",), target.schema, 4)
    stored.replace(target)

    def crash(*_a):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr("tablesync.sources.keyed_table.KeyedTable._publish", crash)
        with pytest.raises(RuntimeError):
            stored.merge(updates, "ts")
    assert rows(stored.read(spark)) == rows(target)
    stored.merge(updates, "ts")
    assert rows(stored.read(spark)) == [(1, "a"), (2, "new"), (4, "d")]


# ---------------------------------------------------------------- changes


def test_change_log_is_checked(spark):
    df = spark.createDataFrame([("U", 1, 1)], "op string, lsn bigint, id int")
    assert cdc.read_change_log(df, "id").count() == 1
    with pytest.raises(ValueError, match="lsn"):
        cdc.read_change_log(df.drop("lsn"), "id")
    with pytest.raises(Exception, match="unknown change operation"):
        cdc.read_change_log(df.withColumn("op", F.lit("X")), "id").collect()


def test_json_payload(spark, target):
    df = spark.createDataFrame([("U", 1, 2, '{"id":2,"v":"x"}'), ("D", 2, 1, None)], "op string, lsn bigint, id int, payload string")
    changes = cdc.read_change_log(df, "id", target.schema)
    assert rows(cdc.cdc_apply(target, changes, "id")) == [(2, "x"), (3, "c")]


def test_apply_ignores_changes_in_the_snapshot(spark, target):
    changes = spark.createDataFrame(
        [("D", 5, 1, None), ("U", 11, 2, "n"), ("U", 12, 2, "m"), ("I", 13, 8, "i"), ("D", 14, 77, None)],
        "op string, lsn bigint, id int, v string",
    )
    assert rows(cdc.cdc_apply(target, changes, "id", 10)) == [(1, "a"), (2, "m"), (3, "c"), (8, "i")]
    assert rows(cdc.cdc_apply(target, changes, "id")) == [(2, "m"), (3, "c"), (8, "i")]
    again = cdc.cdc_apply(cdc.cdc_apply(target, changes, "id"), changes, "id")
    assert rows(again) == [(2, "m"), (3, "c"), (8, "i")]


def test_phases(spark):
    assert cdc.initial_phase("none", True) == "cdc_starting"
    assert cdc.initial_phase("none", False) == "paused"
    assert cdc.initial_phase("full", True) == cdc.initial_phase("incremental", False) == "snapshot_planning"
    changes = spark.createDataFrame([("a", 3), ("a", 9), ("b", 1)], "stream_name string, lsn bigint")
    assert {tuple(r) for r in cdc.cdc_progress(changes).collect()} == {("a", "cdc_running", None, 9), ("b", "cdc_running", None, 1)}
    ledger = spark.createDataFrame([("a", "k1", True), ("b", "k2", False), ("c", "k3", True)], "table_name string, last_chunk_key string, completed boolean")
    assert {tuple(r)[:3] for r in cdc.cdc_progress(changes, ledger).collect()} == {
        ("a", "cdc_running", "k1"), ("b", "snapshot_running", "k2"), ("c", "snapshot_complete", "k3")
    }


# ---------------------------------------------------------------- reconciliation


def test_reconcile(spark):
    src = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "d"), (4, "d"), (None, "n")], "id int, v string")
    dst = spark.createDataFrame([("a", 1), ("x", 2), ("", 3), ("d", 4), ("e", 5), ("n", None)], "v string, id int")
    assert rows(reconcile.reconcile_rows(src, dst, "id")) == [
        (2, "changed", 1, 1), (3, "changed", 1, 1), (4, "changed", 2, 1), (5, "extra", 0, 1)
    ]
    assert reconcile.reconcile_rows(src, src.select("v", "id"), ["id"]).count() == 0
    with pytest.raises(ValueError):
        reconcile.reconcile_rows(src, dst.drop("v"), "id")
    a = spark.createDataFrame([("t",), ("t",), ("u",)], "table_name string")
    b = spark.createDataFrame([("t",), ("t",), ("w",)], "table_name string")
    assert rows(reconcile.reconcile_counts(a, b)) == [("t", 2, 2, True), ("u", 1, 0, False), ("w", 0, 1, False)]
