"""The statements and options given to Spark's JDBC source and sink. No database is started here."""

import pytest

from tablesync.sources import jdbc


def test_quoting():
    assert jdbc.quoted(" public.orders ") == '"public"."orders"'
    assert jdbc.quoted('s.a"b') == '"s"."a""b"'
    with pytest.raises(ValueError):
        jdbc.quoted("orders")


def test_parallel_scan():
    assert jdbc.bounds_query("s.t", "id") == 'SELECT MIN("id") AS lo, MAX("id") AS hi FROM "s"."t"'
    assert jdbc.partition_options("id", 1, 99, 8) == {
        "partitionColumn": '"id"', "lowerBound": "1", "upperBound": "99", "numPartitions": "8"
    }


def test_catalog_queries():
    query = jdbc.columns_query(["b.y", "a.x'"])
    assert "(table_schema = 'a' AND table_name = 'x''') OR (table_schema = 'b' AND table_name = 'y')" in query
    assert "PRIMARY KEY" in jdbc.primary_key_query(["a.x"])


def test_sink_options():
    assert jdbc.sink_options("jdbc:x", "t", 5, {"user": "u"}) == {
        "url": "jdbc:x", "dbtable": "t", "batchsize": "5", "user": "u"
    }
    with pytest.raises(ValueError):
        jdbc.sink_options("jdbc:x", "t", 0)
