import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablesync.functions.codec import project_typed
from tablesync.model import LEDGER
from tablesync.operators.load import load_totals
from tablesync.operators.reconcile import reconcile_rows
from tablesync.plans.jobs import Capture, load_staging, replicate, run_tables, snapshot_to_staging
from tablesync.sources.ledger import load_ledger
from tablesync.sources.raw_store import RawStore
from tablesync.sources.staged import Staging, read_manifest


class Place:
    """A staging area, a raw store and a ledger under one folder."""

    def __init__(self, spark, root):
        self.spark, self.root = spark, str(root)
        self.staging = Staging(f"{root}/staging", "shop")
        self.store = RawStore(f"{root}/raw")

    def run(self, tables, capture, **options):
        return load_totals(
            replicate(self.spark, tables, self.staging, self.store, capture, f"{self.root}/ledger", **options)
        ).first()

    def ledger(self):
        return {r.table_name: r for r in load_ledger(self.spark, f"{self.root}/ledger", "shop").collect()}

    def rows(self, stream, schema):
        return project_typed(self.store.read(self.spark, stream), schema)


@pytest.fixture
def place(spark, tmp_path):
    return Place(spark, tmp_path)


@pytest.fixture
def users(spark):
    return spark.createDataFrame(
        [(i, f"member-{i}", f"m{i}@example.org") for i in range(1, 8)], "id int, name string, email string"
    )


@pytest.fixture
def orders(spark):
    return spark.createDataFrame(
        [(i, i % 7 + 1, f"item-{i}", 5 + i * 250) for i in range(1, 13)],
        "id int, user_id int, product string, amount_cents int",
    )


USERS, ORDERS = "public.members", "public.invoices"
KEYS = {USERS: ["id"], ORDERS: ["id"]}


def test_tables_arrive_once(place, users, orders):
    tables = {USERS: users, ORDERS: orders}
    assert place.run(tables, Capture(chunk_size=5, keys=KEYS)) == (5, 19, 0)
    assert place.rows(USERS, users.schema).exceptAll(users).count() == 0
    assert place.rows(ORDERS, orders.schema).count() == 12
    ledger = place.ledger()
    assert all(r.completed for r in ledger.values())
    assert (ledger[ORDERS].next_sequence, ledger[ORDERS].rows_staged) == (3, 12)
    assert ledger[ORDERS].last_chunk_key.endswith("/00000000000000000002.jsonl.gz")
    # Everything is complete: a rerun captures nothing and adds nothing.
    assert place.run(tables, Capture(chunk_size=5, keys=KEYS)) == (0, 0, 0)
    # Without resume the same chunks are staged again and skipped at load.
    assert place.run(tables, Capture(chunk_size=5, keys=KEYS), resume=False) == (0, 0, 5)
    assert place.store.read(place.spark).count() == 19


def test_unchunked_and_empty_tables(place, users):
    tables = {USERS: users, "public.none": users.limit(0)}
    assert place.run(tables, Capture()) == (2, 7, 0)
    assert {r.stream_name: r.row_count for r in place.store.applied(place.spark).collect()} == {USERS: 7, "public.none": 0}
    assert place.ledger()["public.none"].next_sequence == 1
    # Chunked, an empty table has no chunk but is complete.
    other = Capture(chunk_size=3)
    staged = snapshot_to_staging(
        place.spark, {"public.none": users.limit(0)}, Staging(place.root, "two"), other,
        place.spark.createDataFrame([], LEDGER),
    )
    assert staged.manifest.count() == 0 and staged.progress.first().finished


def test_capped_runs_take_up_where_the_last_one_stopped(place, orders):
    capture = Capture(chunk_size=3, max_rows=5, keys=KEYS)
    totals = [place.run({ORDERS: orders}, capture) for _ in range(4)]
    assert [t.rows_written for t in totals] == [5, 5, 2, 0]
    assert place.ledger()[ORDERS].completed
    assert reconcile_rows(orders, place.rows(ORDERS, orders.schema), "id").count() == 0
    with pytest.raises(ValueError, match="key"):
        place.run({"a.b": orders}, Capture(chunk_size=3, max_rows=5))


def test_chunk_size_may_change_between_capped_runs(place, orders):
    place.run({ORDERS: orders}, Capture(chunk_size=2, max_rows=5, keys=KEYS))
    place.run({ORDERS: orders}, Capture(chunk_size=4, keys=KEYS))
    assert reconcile_rows(orders, place.rows(ORDERS, orders.schema), "id").count() == 0


def test_incremental_runs_equal_one_full_run(place, spark):
    rows = [(i, None if i % 11 == 0 else dt.datetime(2024, 1, 1 + i // 10, 0, 0, 0, i % 3)) for i in range(60)]
    source = spark.createDataFrame(rows, "id int, at timestamp_ntz")
    capture = Capture("incremental", 7, cursor="at", keys={"s.t": ["id"]})
    for day in (2, 4, 4, 30):
        seen = source.filter(F.col("at").isNull() | (F.col("at") < F.lit(dt.datetime(2024, 1, day)).cast("timestamp_ntz")))
        place.run({"s.t": seen}, capture)
    assert reconcile_rows(source, place.rows("s.t", source.schema), "id").count() == 0
    assert place.ledger()["s.t"].last_cursor_value == "2024-01-06 00:00:00.000002"
    # Nothing new is a success with no rows.
    assert place.run({"s.t": source}, capture) == (0, 0, 0)


def test_capped_incremental_runs_lose_no_tie(place, spark):
    source = spark.createDataFrame([(i, None if i < 3 else i // 5) for i in range(24)], "id int, c int")
    capture = Capture("incremental", 4, cursor="c", max_rows=9, keys={"s.t": ["id"]})
    for _ in range(8):
        if place.run({"s.t": source}, capture).rows_written == 0:
            break
    assert reconcile_rows(source, place.rows("s.t", source.schema), "id").count() == 0


def test_updated_rows_are_appended(place, spark):
    capture = Capture("incremental", 10, cursor="v", keys={"s.t": ["id"]})
    place.run({"s.t": spark.createDataFrame([(1, 1), (2, 2)], "id int, v int")}, capture)
    place.run({"s.t": spark.createDataFrame([(1, 3), (2, 2)], "id int, v int")}, capture)
    schema = spark.createDataFrame([], "id int, v int").schema
    assert sorted(map(tuple, place.rows("s.t", schema).collect())) == [(1, 1), (1, 3), (2, 2)]


def test_cursor_that_changes_its_type(place, spark):
    capture = Capture("incremental", 10, cursor="v")
    place.run({"s.t": spark.createDataFrame([(1, 1)], "id int, v int")}, capture)
    with pytest.raises(TypeError):
        place.run({"s.t": spark.createDataFrame([(1, "1")], "id int, v string")}, capture)


def test_mode_none_and_cursor_in_full_mode(place, users):
    assert place.run({USERS: users}, Capture("none")) == (0, 0, 0)
    assert place.ledger() == {}
    place.run({USERS: users}, Capture("full", 3, cursor="id", keys=KEYS))
    assert place.ledger()[USERS].last_cursor_value is None


def test_failed_load_is_captured_again(place, orders, monkeypatch):
    capture = Capture(chunk_size=5, keys=KEYS)

    def crash(*_a, **_k):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(RawStore, "commit", crash)
        with pytest.raises(RuntimeError):
            place.run({ORDERS: orders}, capture)
    assert place.ledger() == {}
    with monkeypatch.context() as m:
        m.setattr("tablesync.plans.jobs.save_ledger", crash)
        with pytest.raises(RuntimeError):
            place.run({ORDERS: orders}, capture)
    # The load before this one was finished, only its ledger was lost.
    assert place.run({ORDERS: orders}, capture) == (0, 0, 3)
    assert reconcile_rows(orders, place.rows(ORDERS, orders.schema), "id").count() == 0
    assert place.ledger()[ORDERS].completed


def test_parquet_folder_without_key(place, spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 103, 1, 5).write.parquet(path)
    assert place.run({"s.t": path}, Capture(chunk_size=10)) == (11, 103, 0)
    sizes = [r.row_count for r in place.store.applied(spark).orderBy("sequence").collect()]
    assert sizes == [10] * 10 + [3]
    assert reconcile_rows(spark.range(103), place.rows("s.t", spark.range(1).schema), "id").count() == 0


def test_tables_run_side_by_side(place, spark):
    tables = {f"s.t{i}": spark.range(i * 10) for i in range(5)}
    assert place.run(tables, Capture(chunk_size=7, parallelism=3)) == (16, 100, 0)
    with pytest.raises(ZeroDivisionError):
        run_tables(spark, lambda n: 1 // 0, ["a", "b"], 2)


def test_load_without_chunks_is_an_error(place):
    with pytest.raises(LookupError):
        load_staging(place.spark, place.staging, place.store)


def test_foreign_chunks_are_loaded(place, spark):
    from test_staging import foreign

    foreign(place.staging, "public.u", 0, '{"id":1}\n\n{"id":2}\n')
    foreign(place.staging, "public.u", 1, '{"id":3}\n')
    assert load_totals(load_staging(spark, place.staging, place.store)).first() == (2, 3, 0)
    assert load_totals(load_staging(spark, place.staging, place.store)).first() == (0, 0, 2)
    assert place.store.read(spark, "public.u").agg(F.max("_row_number")).first()[0] == 2


def test_manifest_describes_the_chunks(place, users):
    place.run({USERS: users}, Capture(chunk_size=5, keys=KEYS))
    rows = read_manifest(place.spark, place.staging).collect()
    assert {r.pipeline_name for r in rows} == {"shop"} and all(len(r.schema_fingerprint) == 64 for r in rows)
    assert all(r.bytes_written > 0 and r.created_at_unix_ms > 1_600_000_000_000 for r in rows)


@pytest.mark.parametrize(
    "bad", [dict(chunk_size=0), dict(mode="incremental"), dict(mode="x"), dict(batch_size=0), dict(parallelism=0)]
)
def test_options_are_checked(place, users, bad):
    with pytest.raises(ValueError):
        place.run({USERS: users}, Capture(**bad))
    with pytest.raises(ValueError):
        place.run({}, Capture())
    with pytest.raises(ValueError):
        place.run({"users": users}, Capture())
