import pytest
from pyspark.sql import functions as F

from tablesync.functions import names as N


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_chunk_key(spark):
    key = one(spark, N.chunk_key("shop-eu", "sales.line_items", 310))
    assert key == (
        "pipelines/shop-eu/streams/sales.line_items/partitions/default/chunks/"
        "00000000000000000310.jsonl.gz"
    )
    key = one(spark, N.chunk_key("p", "sales.line_items", 9, prefix="/lake/eu//"))
    assert key.startswith("lake/eu/pipelines/p/")
    assert key.endswith("/00000000000000000009.jsonl.gz")


@pytest.mark.parametrize(
    "raw, clean", [(" /a/b/ ", "a/b"), ("", ""), ("///", ""), ("\t x/ ", "x"), ("a b", "a b")]
)
def test_normalize_prefix(spark, raw, clean):
    assert one(spark, N.normalize_prefix(raw)) == clean


def test_sanitizers(spark):
    assert one(spark, N.sanitize_name("my pipe/line.é_1")) == "my-pipe-line--_1"
    assert one(spark, N.sanitize_ident("__Public..Orders É-2__")) == "public_orders_2"
    assert one(spark, N.raw_table_name("public.orders")) == '"tablesync_raw"."raw_public_orders"'
    assert one(spark, N.raw_table_name("a.b", 'x"y', "")) == '"x""y"."a_b"'


def test_quoting(spark):
    assert one(spark, N.quote_ident('a"b')) == '"a""b"'
    assert one(spark, N.quote_qualified_table("public.orders")) == '"public"."orders"'


def test_normalize_tables():
    assert N.normalize_tables([" b.x ", "a . y", "b.x"]) == ["a.y", "b.x"]
    for bad in ("users", "", "a.b.c", "a. ", ".b"):
        with pytest.raises(ValueError):
            N.normalize_tables([bad])


def test_raw_name_collisions(spark):
    streams = spark.createDataFrame([("a.b_c",), ("a_b.c",), ("a.b_c",), ("d.e",)], "stream_name string")
    assert [tuple(r) for r in N.raw_name_collisions(streams).collect()] == [
        ('"tablesync_raw"."raw_a_b_c"', 2)
    ]
    N.check_raw_idents({"a.b", "a.c"})
    with pytest.raises(ValueError):
        N.check_raw_idents({"a.b_c", "a_b.c"})


def test_check_agrees_with_expression(spark):
    for name in ("public.Orders", "__x..y__", "é.ü", "A-1.b"):
        with pytest.raises(ValueError):
            N.check_raw_idents({name, one(spark, N.sanitize_ident(name)) + "."})


def test_is_qualified(spark):
    rows = spark.createDataFrame([("a.b",), ("a",), ("a.b.c",), ("a. ",)], "n string")
    assert [r[0] for r in rows.select(N.is_qualified(F.col("n"))).collect()] == [True, False, False, False]
