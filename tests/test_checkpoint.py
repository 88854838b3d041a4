import pytest

from tablesync.model import LEDGER, MANIFEST, PROGRESS
from tablesync.operators import checkpoint as cp
from tablesync.operators.chunking import capture_chunked
from tablesync.sources.ledger import ledger_path, load_ledger, save_ledger


def ledger(spark, *rows):
    full = [
        ("p", t, n, s, k, done, 1, cursor, "string" if cursor else None, None)
        for t, n, s, k, done, cursor in rows
    ]
    return spark.createDataFrame(full, LEDGER)


def manifest(spark, *rows):
    full = [
        tuple({"pipeline_name": "p", "stream_name": t, "sequence": n, "row_count": r, "object_key": f"k{n}"}.get(c)
              for c in MANIFEST.names)
        for t, n, r in rows
    ]
    return spark.createDataFrame(full, MANIFEST)


def by_table(df):
    return {r["table_name"]: r for r in df.collect()}


def test_fold(spark):
    base = ledger(spark, ("a", 2, 20, "k1", True, "c1"), ("b", 1, 5, "k0", True, None))
    out = by_table(cp.fold_checkpoint(base, manifest(spark, ("a", 2, 10), ("a", 3, 4), ("c", 0, 7))))
    assert (out["a"].next_sequence, out["a"].rows_staged, out["a"].last_chunk_key) == (4, 34, "k3")
    assert out["a"].completed is False and out["a"].last_cursor_value == "c1"
    assert out["b"].completed is True and out["b"].updated_at_unix_ms == 1
    assert (out["c"].next_sequence, out["c"].rows_staged) == (1, 7)


def test_rows_staged_saturates(spark):
    base = ledger(spark, ("a", 1, cp.MAX_BIGINT - 1, "k", False, None))
    assert by_table(cp.fold_checkpoint(base, manifest(spark, ("a", 1, 10))))["a"].rows_staged == cp.MAX_BIGINT


def test_cursor_is_kept_on_null(spark):
    rows = ledger(spark)
    for value in ("2024-06", "2024-07", None):
        cursors = spark.createDataFrame([("p", "a", value)], "pipeline_name string, table_name string, cursor_value string")
        rows = cp.update_cursor(rows, cursors)
    assert by_table(rows)["a"].last_cursor_value == "2024-07"


def test_apply_progress_and_complete(spark):
    progress = spark.createDataFrame(
        [("a", 3, True, 10, "9", "bigint", None), ("b", 1, False, 5, None, None, '{"id":"4"}')], PROGRESS
    )
    out = by_table(cp.apply_progress(ledger(spark, ("b", 1, 5, "k", False, None)), progress, "p"))
    assert out["a"].completed and out["a"].last_cursor_value == "9" and out["a"].cursor_type == "bigint"
    assert not out["b"].completed and out["b"].last_key == '{"id":"4"}'
    tables = spark.createDataFrame([("p", "b"), ("p", "z")], "pipeline_name string, table_name string")
    done = by_table(cp.mark_complete(ledger(spark, ("b", 1, 5, "k", False, None)), tables))
    assert done["b"].completed and done["z"].completed and done["z"].next_sequence == 0


def test_table_progress(spark):
    df = spark.createDataFrame([(3,), (10,), (99,)], "c int")
    row = cp.table_progress(capture_chunked(df, ["c"], 2, 4), "a.b", 4, "c", ["c"]).first()
    assert (row.next_sequence, row.rows_emitted, row.max_cursor_value, row.cursor_type) == (6, 3, "99", "int")
    assert row.last_key == '{"c":"99"}' and row.finished
    empty = capture_chunked(df.limit(0), ["c"], 2, 4)
    assert cp.table_progress(empty, "a.b", 4, "c").first().next_sequence == 4
    assert cp.table_progress(empty, "a.b", 4, "c", unchunked=True).first().next_sequence == 5


def test_pending(spark):
    req = spark.createDataFrame([("users",), ("orders",), ("new",)], "table_name string")
    base = ledger(spark, ("users", 5, 9, "k", True, "c"), ("orders", 3, 9, "k", False, None))
    full = by_table(cp.pending_tables(req, base, "p"))
    assert {t: r.start_sequence for t, r in full.items()} == {"orders": 3, "new": 0}
    inc = by_table(cp.pending_tables(req, base, "p", "incremental"))
    assert inc["users"].last_cursor_value == "c" and inc["users"].start_sequence == 5
    assert cp.pending_tables(req, base, "p", "none").count() == 0
    assert {r.start_sequence for r in cp.pending_tables(req, base, "p", resume=False).collect()} == {0}
    assert len(by_table(cp.pending_tables(req, base, "other"))) == 3
    with pytest.raises(ValueError):
        cp.pending_tables(req, base, "p", "sometimes")


def test_all_complete_means_nothing_to_do(spark):
    req = spark.createDataFrame([("users",)], "table_name string")
    assert cp.pending_tables(req, ledger(spark, ("users", 5, 9, "k", True, None)), "p").count() == 0


def test_resume_summary(spark):
    rows = ledger(spark, ("a", 1, 5, "k", True, None), ("b", 1, 6, "k", False, None), ("c", 1, 7, "k", False, None))
    assert cp.resume_summary(rows).first() == (1, 2, 18)
    assert cp.resume_summary(ledger(spark)).first() == (0, 0, 0)


def test_store(spark, tmp_path):
    root = str(tmp_path)
    assert load_ledger(spark, root, "my pipe").count() == 0
    save_ledger(ledger(spark, ("a", 1, 5, "k", True, None)), root, "my pipe")
    saved = save_ledger(ledger(spark, ("a", 2, 9, "k", True, None), ("b", 0, 0, None, False, None)), root, "my pipe")
    assert sorted((r.table_name, r.next_sequence) for r in saved.collect()) == [("a", 2), ("b", 0)]
    assert ledger_path(root, "my pipe").endswith("/my-pipe.snapshot-checkpoints")
    # A save that reads the ledger it replaces.
    again = save_ledger(load_ledger(spark, root, "my pipe"), root, "my pipe")
    assert again.count() == 2
    blank = load_ledger(spark, root, "my pipe").replace("p", "", "pipeline_name")
    save_ledger(blank, root, "my pipe")
    assert {r.pipeline_name for r in load_ledger(spark, root, "my pipe").collect()} == {"my pipe"}
