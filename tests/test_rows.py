"""Strict JSON lines, rows with any column names, key selection and digest trees."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.functions import codec
from tablesync.operators import chunking, reconcile
from tablesync.plans import jobs
from tablesync.sources import capture

A = T.StructType([T.StructField("a", T.IntegerType())])
BAD = [
    '{"a":1}] x', '{"a":1}]', '{"a":1}],[', '1] [2', "{'a':1}", "NaN", '{"a":NaN}', '{"a":1},{"a":2}', '{"a":1} x', "[1", "1,2", '{"a":',
    '{"a":1}}', '"x', '{"a":1},"y"', "Infinity", "// no", '{"a":1}\n{"a":2}', '{"a":1},', ',{"a":1}', "{\"a\":1}]]]",
]
GOOD = ['{"a":1}', "null", "[1,2]", '"text] [ \\" "', "1.5e3", "true", '{"a":1,"a":2}', ' {"a":[{"b":"]"}]} ', "{}", "[]", '["\\u2402end of line\\u2403"]']


def lines(spark, values):
    return spark.createDataFrame([(v,) for v in values], "value string")


@pytest.mark.parametrize("value", BAD)
def test_bad_lines_are_refused(spark, value):
    with pytest.raises(Exception, match="invalid staged JSON"):
        lines(spark, [value]).select(codec.checked_json(F.col("value"))).collect()
    for schema in (None, A):
        with pytest.raises(Exception):
            codec.decode_lines(lines(spark, [value]), schema).collect()


@pytest.mark.parametrize("value", [v for v in BAD if "NaN" not in v and v not in ("Infinity",)])
def test_typed_projection_refuses_them_too(spark, value):
    with pytest.raises(Exception):
        codec.project_typed(lines(spark, [value]), A, "value").collect()


def test_good_lines_of_any_kind_and_size(spark):
    got = lines(spark, [*GOOD, None]).select(codec.checked_json(F.col("value"))).collect()
    assert [r[0] for r in got] == [*GOOD, None]
    big = spark.range(1).select(F.concat(F.lit('{"a":"'), F.repeat(F.lit("x]"), 11_000_000), F.lit('"}')).alias("value"))
    assert big.select(F.length(codec.checked_json(F.col("value")))).first()[0] == 22_000_008
    typed = codec.project_typed(big, T.StructType.fromDDL("a string"), "value")
    assert typed.select(F.length("a")).first()[0] == 22_000_000


def test_not_a_number_survives(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, -float("inf"))], "i int, x double")
    assert str(codec.project_typed(codec.encode_rows(df), df.schema, "record").collect()) == str(df.collect())


def test_kept_columns_may_share_names_with_typed_ones(spark):
    raw = spark.createDataFrame([(1, '{"_typed":5,"_kept":6}')], "k int, _data string")
    assert [tuple(r) for r in codec.project_typed(raw, T.StructType.fromDDL("_typed int, _kept int"), keep=["k"]).collect()] == [(1, 5, 6)]


NAMES = ["_tie", "_scan_pos", "_row_id", "_row", "_pos", "_file", "_file_key", "_partition", "_offset", "_bytes", "a.b", "Stream_Name"]


def test_numbering_of_odd_names(spark, tmp_path):
    df = spark.range(50).select(*[(F.col("id") * 7 % 50).alias(n) for n in NAMES])
    out = chunking.capture_chunked(df, ["_tie"], 20)
    assert all(r["_tie"] == r["_row_index"] == r["a.b"] and r["sequence"] == r["_tie"] // 20 for r in out.collect())
    df.write.parquet(str(tmp_path / "t"))
    numbered = chunking.number_files(spark, str(tmp_path / "t")).df
    assert sorted(r["_row_index"] for r in numbered.collect()) == list(range(50))
    assert [c for c in numbered.columns if c != "_row_index"] == NAMES
    taken = df.withColumn("_row_index", F.lit(1))
    with pytest.raises(ValueError, match="_row_index"):
        chunking.number_rows(taken)
    assert chunking.number_rows(taken, packed=True).df.count() == 50


def test_files_are_numbered_without_moving_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tablesync.session.SMALL_ROWS", 0)
    spark.range(0, 3000, 1, 40).write.parquet(str(tmp_path / "t"))
    numbered = chunking.number_files(spark, str(tmp_path / "t"))
    plan = numbered.df._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "SortMergeJoin" not in plan
    rows = plan.split("BroadcastExchange")[0]
    assert "Exchange" not in rows.replace("BroadcastHashJoin", "")
    assert numbered.total == 3000 and numbered.df.agg(F.count_distinct("_row_index"), F.max("_row_index")).first() == (3000, 2999)


def test_writers_do_not_depend_on_the_session(spark, tmp_path):
    from tablesync.sources import staged

    rows = chunking.assign_sequence(chunking.number_rows(spark.range(300), packed=True).df, 3).withColumn("stream_name", F.lit("a.b"))
    staging = staged.Staging(str(tmp_path), "p")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        staged.write_chunks(rows, staging, None, "r", chunk_count=100)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    manifest = staged.chunk_manifest(spark, staging, ["r"])
    assert manifest.count() == 100 and manifest.filter("row_count <> 3 or file_count <> 1").count() == 0


# ------------------------------------------------------------ selection


@pytest.mark.parametrize("seed", range(4))
def test_selected_rows_equal_sorted_rows(spark, seed, monkeypatch):
    monkeypatch.setattr(capture, "PIVOTS", 3)
    rng = random.Random(seed)
    data = [(rng.choice([None, 1, 2, 3, rng.randrange(50)]), rng.choice("ab"), 0 if seed % 2 else i) for i in range(300)]
    df = spark.createDataFrame(data, "k int, _tie string, v int").repartition(4)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1])
    for n in (1, 150, 299, 300, 301):
        got = [tuple(r) for r in capture.capture_bounded(df, ["k", "_tie"], n, top_k=10).collect()]
        assert sorted(map(order, got)) == sorted(map(order, data))[:n]
        left = list(data)
        for r in got:
            left.remove(r)
        position = capture.selected_position(df, ["k", "_tie"], n, 10)
        if n > 300:
            assert position is None
            continue
        nth = sorted(map(order, data))[n - 1]
        at = lambda v: None if v is None else int(v)
        found, below = position
        assert order((at(found["k"]), found["_tie"])) == nth
        assert below == sum(order(r) < nth for r in data)


def test_selection_does_not_sort(spark, monkeypatch):
    monkeypatch.setattr(chunking, "scratch_path", None)
    df = spark.range(5000).select((F.col("id") * 37 % 5000).alias("k"))
    assert capture.selected_position(df, ["k"], 4000, 100) == ({"k": "3999"}, 3999)


# ------------------------------------------------------------ digest trees


@pytest.mark.parametrize("kind", ["equal", "few", "all", "empty"])
def test_tree_equals_row_comparison(spark, kind):
    source = spark.range(4000).select(F.col("id").alias("_range"), (F.col("id") % 7).alias("_src"))
    if kind == "empty":
        source = source.limit(0)
    wrong = {"equal": F.lit(False), "few": F.col("_range") % 1000 == 3, "all": F.lit(True), "empty": F.lit(False)}[kind]
    dest = source.withColumn("_src", F.when(wrong, -1).otherwise(F.col("_src"))).filter(~(wrong & (F.col("_range") % 2000 == 3)))
    source = source.withColumnRenamed("_src", "v")
    dest = dest.withColumnRenamed("_src", "v")
    tree = sorted(tuple(r) for r in reconcile.reconcile_tree(source, dest, "_range").collect())
    assert tree == sorted(tuple(r) for r in reconcile.reconcile_rows(source, dest, ["_range"]).collect())
    assert bool(tree) == (kind in ("few", "all"))


def test_rows_compared_are_those_of_unequal_ranges(spark):
    source = spark.range(20000).withColumn("v", F.col("id") % 5)
    dest = source.withColumn("v", F.when(F.col("id") == 17, 9).otherwise(F.col("v")))
    mine, theirs, levels = reconcile.unequal_ranges(source, dest, ["id"], limit=4)
    assert levels >= 2 and mine.count() <= 2 and theirs.count() <= 2
    # swapped values within a range show as well
    swapped = source.withColumn("v", F.when(F.col("id") == 17, 3).when(F.col("id") == 18, 2).otherwise(F.col("v")))
    assert {r.id for r in reconcile.reconcile_tree(source, swapped, "id").collect()} == {17, 18}


def test_whole_capture_of_odd_names(spark):
    rows = spark.range(3).select(F.col("id").alias("sequence"))
    assert jobs.pack(rows) is not None and chunking.unpack(rows.select(chunking.pack(rows))).columns == ["sequence"]
