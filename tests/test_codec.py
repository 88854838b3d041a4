import datetime as dt
import decimal
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.functions import codec


def test_round_trip_of_every_type(spark):
    schema = T.StructType.fromDDL(
        "i bigint, d decimal(38,18), f double, s string, b boolean, bin binary, day date, "
        "at timestamp, ntz timestamp_ntz, arr array<int>, st struct<x:int,y:string>, m map<string,int>"
    )
    row = (
        2**53 + 1, decimal.Decimal("12345678901234567890.123456789012345678"), 0.1,
        'a\n"b"\\ é  ', True, bytearray(b"\x00\xff"), dt.date(2024, 2, 29),
        dt.datetime(2024, 1, 1, 1, 2, 3, 456789), dt.datetime(2024, 1, 1, 1, 2, 3, 1),
        [1, None, 3], (1, None), {"k": 5},
    )
    df = spark.createDataFrame([row, tuple([None] * len(row))], schema)
    records = codec.encode_rows(df)
    assert all("\n" not in r.record for r in records.collect())
    assert json.loads(records.collect()[1].record) == {c: None for c in df.columns}
    back = codec.project_typed(records, schema, "record")
    assert back.collect() == df.collect()
    assert back.schema.simpleString() == df.schema.simpleString()


def test_json_column_is_embedded_only_on_request(spark):
    df = spark.createDataFrame([('{"k": 1}',)], "props string")
    assert json.loads(codec.encode_rows(df).first()[0]) == {"props": '{"k": 1}'}
    assert json.loads(codec.encode_rows(df, json_columns=["props"]).first()[0]) == {"props": {"k": 1}}


def test_intervals_are_refused(spark):
    with pytest.raises(TypeError):
        codec.encode_rows(spark.sql("SELECT INTERVAL 1 DAY AS d"))


def test_decode_drops_blank_lines_and_fails_on_bad_ones(spark):
    lines = spark.createDataFrame([('{"id":1}',), ("",), (" \t\r",), ('  {"id":2} \r',), ('{"id":3}',)], "value string")
    typed = codec.decode_lines(lines, T.StructType.fromDDL("id int"))
    assert [r.value.id for r in typed.collect()] == [1, 2, 3]
    assert codec.decode_lines(lines).count() == 3
    bad = spark.createDataFrame([("{oops",)], "value string")
    for schema in (None, T.StructType.fromDDL("id int")):
        with pytest.raises(Exception):
            codec.decode_lines(bad, schema).collect()
    with pytest.raises(Exception, match="invalid staged JSON"):
        bad.select(codec.checked_json(F.col("value"))).collect()


def test_digest_ignores_order_but_not_copies(spark):
    def digest(values):
        return spark.createDataFrame([(v,) for v in values], "v string").agg(codec.content_digest(F.col("v"))).first()[0]

    assert digest(["a", "b", "b"]) == digest(["b", "a", "b"])
    assert digest(["a", "b"]) != digest(["a", "b", "b"])
    assert digest(["a", "a"]) != digest(["b", "b"])
    assert digest([]) == "0-0-0"


def test_a_line_is_parsed_once(spark):
    rows = spark.createDataFrame([('{"a":1,"b":"x"}', 1), (None, 2)], "_data string, k long")
    typed = codec.project_typed(rows, T.StructType.fromDDL("a long, b string"), keep=["k"])
    plan = typed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
    assert sorted(tuple(r) for r in typed.collect()) == [(1, 1, "x"), (2, None, None)]
