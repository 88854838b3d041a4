import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.functions import cursor as C
from tablesync.operators import chunking
from tablesync.sources import capture


def ids(df, column="id"):
    return sorted(r[0] for r in df.select(column).collect())


def test_cursor_values(spark):
    assert spark.range(1).select(C.cursor_literal("it's a test", T.StringType())).first()[0] == "it's a test"
    for bad in ({"a": 1}, [1], True, None, b"x"):
        with pytest.raises(TypeError):
            C.cursor_literal(bad, T.StringType())
    for dtype in (T.BooleanType(), T.BinaryType(), T.ArrayType(T.IntegerType())):
        with pytest.raises(TypeError):
            C.check_cursor_type(dtype)


@pytest.mark.parametrize(
    "ddl, low, high",
    [
        ("bigint", 2**53, 2**53 + 1),
        ("string", "2024-01-01T00:00:00Z", "2024-06-01T00:00:00Z"),
        ("double", 0.1, 0.30000000000000004),
        ("timestamp_ntz", dt.datetime(2024, 1, 1, 0, 0, 0, 1), dt.datetime(2024, 1, 1, 0, 0, 0, 2)),
        ("timestamp", dt.datetime(2024, 1, 1, 0, 0, 0, 1), dt.datetime(2024, 1, 1, 0, 0, 0, 2)),
        ("date", dt.date(2024, 1, 1), dt.date(2024, 1, 2)),
    ],
)
def test_cursor_text_is_lossless(spark, ddl, low, high):
    df = spark.createDataFrame([(low,), (high,)], f"c {ddl}")
    dtype = df.schema["c"].dataType
    text = df.agg(C.cursor_text(F.max("c"), dtype)).first()[0]
    assert capture.capture_incremental(df, "c", text).count() == 0
    text = df.agg(C.cursor_text(F.min("c"), dtype)).first()[0]
    assert [r[0] for r in capture.capture_incremental(df, "c", text).collect()] == [high]


def test_zoned_cursor_survives_another_time_zone(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 7, 1),)], "c timestamp")
    text = df.agg(C.cursor_text(F.max("c"), T.TimestampType())).first()[0]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert capture.capture_incremental(df, "c", text).count() == 0
        assert capture.capture_incremental(df, "c", str(int(text) - 1)).count() == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_max_cursor(spark):
    assert capture.max_cursor(spark.createDataFrame([(10,), (3,), (99,), (None,)], "c int"), "c").first()[0] == 99
    assert capture.max_cursor(spark.createDataFrame([(None,)], "c int"), "c").first()[0] is None


def test_incremental_keeps_nulls_only_at_first(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 7)], "id int, c int")
    assert ids(capture.capture_incremental(df, "c")) == [1, 2, 3]
    assert ids(capture.capture_incremental(df, "c", 5)) == [3]
    assert ids(capture.capture_incremental(df, "c", 7, overlap=2)) == [3]
    assert ids(capture.capture_incremental(df, "c", 7, overlap=3)) == [2, 3]


def test_capped_capture_keeps_ties_and_nulls(spark):
    rows = [(i, None if i < 2 else i // 4) for i in range(20)]
    df = spark.createDataFrame(rows, "id int, c int")
    part, cut = capture.capture_capped(df, "c", 3)
    assert cut and ids(part) == [0, 1, 2, 3, 4, 5, 6, 7]
    seen, last = [], None
    while True:
        left = df if last is None else capture.capture_incremental(df, "c", last)
        part, cut = capture.capture_capped(left, "c", 3)
        seen += ids(part)
        last = part.agg(F.max("c")).first()[0]
        if not cut:
            break
    assert sorted(seen) == list(range(20))
    with pytest.raises(ValueError):
        capture.capture_capped(df, "c", 0)


def test_capped_by_two_columns_above_the_top_k_limit(spark, monkeypatch):
    df = spark.createDataFrame([(i % 3, i) for i in range(30)], "a int, b int")
    small = ids(capture.capture_capped(df, ["a", "b"], 14)[0], "b")
    bounded = ids(capture.capture_bounded(df, ["a", "b"], 14), "b")
    monkeypatch.setattr(capture, "TOP_K_ROWS", 5)
    assert ids(capture.capture_capped(df, ["a", "b"], 14)[0], "b") == small
    assert ids(capture.capture_bounded(df, ["a", "b"], 14), "b") == bounded
    assert len(small) == len(bounded) == 14
    text = df.filter(F.col("a") == 0).agg(capture.last_position(df.schema, ["a", "b"])).first()[0]
    assert set(r.a for r in capture.after_key(df, capture.position_from_text(text)).collect()) == {1, 2}


def test_cursor_filter_reaches_the_scan(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = capture.capture_incremental(orders, "o_orderdate", "1998-01-01 00:00:00")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThan(o_orderdate,1998-01-01T00:00)]" in plan


def test_capture_tables(spark):
    a, b = spark.range(2).toDF("x"), spark.range(3).toDF("y")
    rows = capture.capture_tables({"s.b ": b, " s.a": a})
    assert rows.groupBy("stream_name").count().orderBy("stream_name").collect() == [("s.a", 2), ("s.b", 3)]
    with pytest.raises(ValueError):
        capture.capture_tables({"nodots": a})


# ---------------------------------------------------------------- chunks


@pytest.mark.parametrize("n, size", [(0, 4), (3, 4), (8, 4), (9, 4), (100, 7)])
def test_chunks_are_full_and_in_order(spark, n, size):
    df = spark.range(n).select((F.lit(n) - F.col("id")).alias("id"))
    chunked = chunking.capture_chunked(df, ["id"], size, 5)
    rows = chunked.orderBy("id").collect()
    assert [r["_row_index"] for r in rows] == list(range(n))
    assert [r["sequence"] for r in rows] == [5 + i // size for i in range(n)]


def test_chunk_size_must_be_positive(spark):
    for bad in (0, -1):
        with pytest.raises(ValueError):
            chunking.capture_chunked(spark.range(1), ["id"], bad)


def test_one_key_and_one_row_holding_a_third_of_all(spark):
    rows = spark.range(0, 9000, 1, 6).select(
        F.when(F.col("id") < 3000, 7).otherwise(F.col("id")).alias("k"),
        F.when(F.col("id") < 3000, F.lit(1)).otherwise(F.lit(2)).alias("v"),
    )
    numbered = chunking.number_rows(rows, ["k"])
    assert numbered.total == 9000
    assert numbered.df.agg(F.countDistinct("_row_index"), F.max("_row_index")).first() == (9000, 8999)
    assert numbered.df.drop("_row_index").exceptAll(rows).count() == 0
    ordered = numbered.df.agg(F.max(F.when(F.col("k") == 7, F.col("_row_index")))).first()[0]
    assert ordered == 2999
    # The copies of one row were sorted by several tasks.
    written = spark.read.parquet(numbered.path).filter("_row.k = 7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        again = chunking.number_rows(rows, ["k"])
        written = spark.read.parquet(again.path).filter("_row.k = 7")
        assert written.select(F.shiftright("_row_id", 33)).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_numbering_rows_with_maps_and_no_order(spark):
    df = spark.createDataFrame([(1, {"a": 1}), (2, {"b": 2}), (2, None)], "k int, m map<string,int>")
    assert sorted(r[0] for r in chunking.number_rows(df, ["k"]).df.select("_row_index").collect()) == [0, 1, 2]
    assert sorted(r[0] for r in chunking.number_rows(df).df.select("_row_index").collect()) == [0, 1, 2]


def test_release_deletes_the_scratch_copy(spark):
    numbered = chunking.number_rows(spark.range(3))
    numbered.release()
    with pytest.raises(Exception):
        spark.read.parquet(numbered.path)


def test_number_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 1000, 1, 7).write.parquet(path)
    spark.range(1000, 1003).coalesce(1).write.mode("append").parquet(path)
    numbered = chunking.number_files(spark, path)
    assert numbered.total == 1003
    assert numbered.df.agg(F.countDistinct("_row_index"), F.max("_row_index")).first() == (1003, 1002)
    plan = numbered.df._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan


def test_no_plan_moves_all_rows_to_one_task(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    chunked = chunking.capture_chunked(orders, ["o_orderkey"], 100)
    assert "SinglePartition" not in chunked._jdf.queryExecution().toString()
