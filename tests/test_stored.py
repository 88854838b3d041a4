"""Tables merged on read, commits, ledgers with several writers, compaction and clean-up."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tests_helpers import stage_rows

from tablesync.model import LEDGER
from tablesync.plans.jobs import load_staging
from tablesync.sources import commits, ledger
from tablesync.sources.delta_table import DeltaTable
from tablesync.sources.raw_store import RawStore
from tablesync.sources.staged import Staging, read_manifest, remove_loaded

SCHEMA = T.StructType([T.StructField(n, T.StringType() if n in ("run", "gone") else T.LongType()) for n in ("bucket", "run", "at", "gone")])


def files(path):
    return sorted(os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))


def rows(spark, data, extra=""):
    return spark.createDataFrame(data, "bucket bigint, run string, at bigint, gone string" + extra)


def stored(df):
    return sorted(tuple(r) for r in df.collect())


def test_one_key_writes_one_small_file(spark, tmp_path):
    table = DeltaTable(str(tmp_path), ("bucket",), SCHEMA, 4)
    table.replace(rows(spark, [(i, f"r{i}", 0, None) for i in range(1000)]))
    before = {f: os.path.getmtime(f) for f in files(tmp_path)}
    table.upsert(rows(spark, [(7, "new", 1, None)]), "at")
    new = [f for f in files(tmp_path) if f not in before]
    assert len(new) == 1 and os.path.getsize(new[0]) < 3000
    assert {f: os.path.getmtime(f) for f in before} == before
    assert table.read(spark).count() == 1000
    assert table.read(spark).filter("bucket = 7").first()["run"] == "new"
    assert table.read(spark, version=1).filter("bucket = 7").first()["run"] == "r7"


def test_base_rows_are_not_shuffled_by_key(spark, tmp_path):
    table = DeltaTable(str(tmp_path), ("bucket",), SCHEMA, 2)
    table.replace(rows(spark, [(i, "r", 0, None) for i in range(500)]))
    table.upsert(rows(spark, [(7, "new", 1, None)]), "at")
    plan = table.read(spark)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("tier", [2, 3, 50])
def test_random_changes_equal_a_dictionary(spark, tmp_path, tier):
    rng = random.Random(tier)
    table, kept = DeltaTable(str(tmp_path), ("bucket", "run"), SCHEMA, 3, tier=tier), {}
    table.replace(rows(spark, [(i, "a", 0, "x") for i in range(30)]))
    kept = {(i, "a"): (i, "a", 0, "x") for i in range(30)}
    for step in range(1, 8):
        changes = [
            (rng.randrange(40), rng.choice("ab"), step * 100 + n, rng.choice(["x", "y", None]), rng.choice("UUD")) for n in range(rng.randrange(1, 12))
        ]
        table.merge(rows(spark, changes, ", op string"), "at")
        for *row, op in changes:
            kept.pop((row[0], row[1]), None)
            if op == "U":
                kept[(row[0], row[1])] = tuple(row)
        if step == 5:
            table.compact(spark, everything=True)
        assert sorted(map(str, kept.values())) == sorted(str(tuple(r)) for r in table.read(spark).collect())
    assert max(len(r) for r in table.runs(spark).values()) <= 3 * tier


def test_order_column_beats_arrival(spark, tmp_path):
    table = DeltaTable(str(tmp_path), ("bucket",), SCHEMA, 2, order="at", tier=3)
    rng, best = random.Random(3), {}
    for _ in range(8):
        batch = [(rng.randrange(12), f"r{rng.random()}", rng.randrange(1000), None) for _ in range(6)]
        batch = list({(r[0], r[2]): r for r in batch if (r[0], r[2]) not in {(b[0], b[2]) for b in best.values()}}.values())
        table.keep_latest(rows(spark, batch))
        for r in batch:
            if r[0] not in best or r[2] > best[r[0]][2]:
                best[r[0]] = r
        assert sorted(map(str, best.values())) == sorted(str(tuple(r)) for r in table.read(spark).collect())


def test_two_writers_lose_no_change(spark, tmp_path, monkeypatch):
    table = DeltaTable(str(tmp_path), ("bucket",), SCHEMA, 2)
    table.replace(rows(spark, [(1, "a", 0, None)]))
    real, other = DeltaTable._write, []

    def slow(self, df, ordinal):
        out = real(self, df, ordinal)
        if not other:
            other.append(1)
            table.upsert(rows(spark, [(2, "other", 5, None), (3, "other", 5, None)]), "at")
        return out

    monkeypatch.setattr(DeltaTable, "_write", slow)
    table.upsert(rows(spark, [(3, "mine", 6, None)]), "at")
    assert {(r.bucket, r.run) for r in table.read(spark).collect()} == {(1, "a"), (2, "other"), (3, "mine")}


def test_vacuum_spares_readers_and_young_files(spark, tmp_path):
    table = DeltaTable(str(tmp_path), ("bucket",), SCHEMA, 2)
    table.replace(rows(spark, [(i, "a", 0, None) for i in range(20)]))
    reader = table.read(spark)
    table.replace(rows(spark, [(i, "b", 0, None) for i in range(10)]))
    assert table.vacuum(spark) == 0 and reader.count() == 20
    assert table.vacuum(spark, keep_versions=2, grace_ms=-1000) == 0 and reader.count() == 20
    table._write(table._alive(rows(spark, [(5, "dead", 0, None)])), 99)
    assert table.vacuum(spark, grace_ms=-1000) >= 2
    assert stored(table.read(spark).select("bucket", "run")) == [(i, "b") for i in range(10)]
    assert len(files(tmp_path)) == 2


def test_empty_and_unlike_tables(spark, tmp_path):
    table = DeltaTable(str(tmp_path), ("bucket",), SCHEMA, 2)
    assert table.read(spark).count() == 0 and table.compact(spark) == 0 and table.vacuum(spark) == 0
    table.upsert(rows(spark, []), "at")
    assert table.version(spark) == 0
    table.replace(rows(spark, []))
    assert table.read(spark).count() == 0
    table.upsert(rows(spark, [(1, "a", 0, None)]), "at")
    with pytest.raises(ValueError, match="buckets"):
        DeltaTable(str(tmp_path), ("bucket",), SCHEMA, 3).read(spark)
    with pytest.raises(ValueError, match="order column"):
        table.keep_latest(rows(spark, []))


# ------------------------------------------------------------ commits and ledger


def test_commits_appear_once(spark, tmp_path):
    folder = str(tmp_path / "log")
    assert commits.newest_commit(spark, folder) == (0, None)
    commits.commit(spark, folder, 1, "one é")
    with pytest.raises(commits.CommitConflict):
        commits.commit(spark, folder, 1, "other")
    assert commits.newest_commit(spark, folder) == (1, "one é")
    open(f"{folder}/{2:020d}", "w").close()  # a writer that died
    assert commits.newest_commit(spark, folder)[0] == 1


def entry(spark, *names):
    data = [("p", n, 1, 1, "k", False, 0, None, None, None) for n in names]
    return spark.createDataFrame(data, LEDGER)


def test_ledger_of_two_writers(spark, tmp_path):
    root = str(tmp_path)
    first, version = ledger.load_version(spark, root, "p")
    assert version == 0
    ledger.save_ledger(first.unionByName(entry(spark, "a.a")), root, "p", version)
    with pytest.raises(ledger.LedgerConflict):
        ledger.save_ledger(first.unionByName(entry(spark, "b.b")), root, "p", version)
    calls = []

    def change(now):
        calls.append(1)
        if len(calls) == 1:  # another writer comes in between
            ledger.save_ledger(now.unionByName(entry(spark, "c.c")), root, "p")
        return now.unionByName(entry(spark, "b.b"))

    ledger.update_ledger(spark, root, "p", change)
    assert {r.table_name for r in ledger.load_ledger(spark, root, "p").collect()} == {"a.a", "b.b", "c.c"}
    assert len(calls) == 2 and ledger.ledger_version(spark, root, "p") == 3


# ------------------------------------------------------------ raw store and staging


def test_compacted_loads(spark, tmp_path):
    staging, store = Staging(str(tmp_path / "s"), "shop"), RawStore(str(tmp_path / "raw"))
    for i in range(3):
        stage_rows(spark, staging, spark.range(i * 10, i * 10 + 10), 10, f"r{i}", stream=f"public.t{i % 2}" if i < 2 else "public.u")
        load_staging(spark, staging, store)
    raw = str(tmp_path / "raw")
    assert store.compact(spark) == 3
    reader = store.read(spark)
    assert reader.count() == 30 and reader.select("_load_id").distinct().count() == 1
    assert load_staging(spark, staging, store).filter("not skipped").count() == 0
    assert store.vacuum(spark) == 0
    many = len(files(raw))
    assert store.vacuum(spark, grace_ms=-1000) == 3 and len(files(raw)) < many
    assert reader.count() == 30 and store.read(spark, "public.u").count() == 10
    assert store.applied(spark).count() == 3
    # a later load goes beside it, and may supersede one of its chunks
    stage_rows(spark, staging, spark.range(100, 105), 10, "r9", stream="public.u")
    load_staging(spark, staging, store, replace=True)
    assert store.read(spark, "public.u").count() == 5 and store.read(spark).count() == 25
    assert store.compact(spark) == 2 and store.read(spark).count() == 25
    assert store.applied(spark).count() == 3 and store.compact(spark) == 0


def test_dead_load_is_removed(spark, tmp_path):
    staging, store = Staging(str(tmp_path / "s"), "shop"), RawStore(str(tmp_path / "raw"))
    stage_rows(spark, staging, spark.range(10), 10, "r1")
    load_staging(spark, staging, store)
    lines = store.read(spark).select(
        F.col("_object_key").alias("object_key"), F.col("_sequence").alias("sequence"), "_row_number",
        F.col("_data").alias("value"), F.lit("public.t").alias("stream_name"),
    )
    store.write_rows(lines, "dead")
    assert store.vacuum(spark) == 0 and store.vacuum(spark, grace_ms=-1000) == 1
    assert store.read(spark).count() == 10


def test_loaded_chunks_are_removed(spark, tmp_path):
    staging, store = Staging(str(tmp_path / "s"), "shop"), RawStore(str(tmp_path / "raw"))
    stage_rows(spark, staging, spark.range(10), 5, "r1")
    load_staging(spark, staging, store)
    stage_rows(spark, staging, spark.range(3), 5, "r2", stream="public.later")
    os.makedirs(f"{staging.chunks}/attempt=crashed")
    assert remove_loaded(spark, staging, store.applied(spark)) == 0
    time.sleep(0.01)
    assert remove_loaded(spark, staging, store.applied(spark), grace_ms=-1000) == 2
    assert {r.stream_name for r in read_manifest(spark, staging).collect()} == {"public.later"}
    load_staging(spark, staging, store)
    assert store.read(spark, "public.later").count() == 3 and store.read(spark).count() == 13


# ------------------------------------------------------------ schema versions


def test_schema_versions(spark, tmp_path):
    from tablesync.sources.evolving_table import EvolvingTable

    table = EvolvingTable(str(tmp_path))
    assert table.read(spark).columns == [] and table.schema(spark).columns == ()
    long, text = T.LongType(), T.StringType()
    table.change(spark, add=[T.StructField("a", T.IntegerType()), T.StructField("b", T.ArrayType(text))])
    table.append(spark.createDataFrame([(1, ["x"])], "a int, b array<string>"))
    before = files(tmp_path)
    table.change(spark, rename={"a": "b", "b": "a"}, widen={"a": long})
    table.append(spark.createDataFrame([(2**40, None)], "b long, a array<string>"))
    table.change(spark, drop=["a"], add=[T.StructField("a", text)])
    assert stored(table.read(spark)) == [(1, None), (2**40, None)] and table.read(spark).columns == ["b", "a"]
    assert table.read(spark, 2).filter("a is not null").first().a == ["x"]
    assert set(before) <= set(files(tmp_path)) and table.versions(spark) == [1, 2, 3]
    for bad in ({"widen": {"b": text}}, {"rename": {"x": "y"}}, {"rename": {"b": "A"}}, {"add": [T.StructField("B", long)]}):
        with pytest.raises(ValueError):
            table.change(spark, **bad)
    with pytest.raises(ValueError, match="other"):
        table.append(spark.createDataFrame([(1,)], "other int"))
