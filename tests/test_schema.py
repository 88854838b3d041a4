import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.operators import schema as S


def ddl(text):
    return T.StructType.fromDDL(text)


def test_discover_columns(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id int not null, name string")
    rows = S.discover_columns({"s.t": df}).collect()
    assert [(r.ordinal, r.column_name, r.data_type, r.is_nullable) for r in rows] == [
        (1, "id", "int", False), (2, "name", "string", True)
    ]
    seen = S.discover_columns({"s.t": df, "s.e": df.limit(0)}, observe_nulls=True)
    assert {(r.name, r.column_name): r.is_nullable for r in seen.collect()} == {
        ("t", "id"): False, ("t", "name"): True, ("e", "id"): False, ("e", "name"): False
    }


def test_discover_tables_known_to_the_session(spark):
    with pytest.raises(LookupError):
        S.discover_tables(spark, ["default.no_such_table"])


def test_keys(spark):
    keys = S.declared_keys(spark, {"s.t": ["b", "a"]}).collect()
    assert [(r.ordinal, r.column_name) for r in keys] == [(1, "b"), (2, "a")]
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (3, "y")], "a int, b string")
    assert {tuple(r) for r in S.verify_key(df, ["a", "b"]).collect()} == {
        (1, "x", 2, "duplicate"), (2, None, 1, "null key")
    }
    assert S.verify_key(df.filter("a = 3"), ["a"]).count() == 0


def test_missing_tables_in_request_order(spark):
    catalog = S.catalog_of(spark, {"s.a": ddl("x int"), "s.b": ddl("x int")})
    req = spark.createDataFrame([(0, "s.z"), (1, "s.a"), (2, "bad"), (3, "s.c")], "position int, table_name string")
    assert [r.table_name for r in S.missing_tables(req, catalog).collect()] == ["s.z", "bad", "s.c"]


def test_snapshot_plan(spark):
    names = spark.createDataFrame([("public.orders",)], "table_name string")
    assert S.snapshot_plan(names, 100).first() == ("public.orders", 'SELECT * FROM "public"."orders"', 100, "full")
    assert S.snapshot_plan(names).first().chunk_size is None
    bad = spark.createDataFrame([("users",)], "table_name string")
    with pytest.raises(Exception, match="schema.table"):
        S.snapshot_plan(bad).collect()


def test_fingerprint(spark):
    a, b = ddl("x int, y string"), ddl("y string, x int")
    assert S.schema_fingerprint(a) == S.schema_fingerprint(ddl("x int, y string"))
    assert len({S.schema_fingerprint(s) for s in (a, b, ddl("x bigint, y string"), ddl("x int not null, y string"))}) == 4
    assert spark.range(1).select(S.fingerprint_column(a)).first()[0] == S.schema_fingerprint(a)


def test_schema_diff(spark):
    old = S.catalog_of(spark, {"s.t": ddl(
        "same int, gone string, narrow bigint, wide int, other string, dec decimal(10,2), dec2 decimal(10,2), f double")})
    new = S.catalog_of(spark, {"s.t": ddl(
        "same int, added string, narrow int, wide bigint, other int, dec decimal(8,2), dec2 decimal(12,2), f float")})
    out = {r.column: (r.change_type, r.resolution) for r in S.schema_diff(old, new, S.AUTO_APPLY, S.IGNORE).collect()}
    assert out == {
        "added": ("additive", "auto_applied"), "gone": ("breaking", "ignored"),
        "narrow": ("breaking", "ignored"), "wide": ("unknown", "detected"), "other": ("unknown", "detected"),
        "dec": ("breaking", "ignored"), "dec2": ("unknown", "detected"), "f": ("breaking", "ignored"),
    }


def test_evolve(spark):
    target = spark.createDataFrame([(1, "a", 5)], "id bigint, name string, n bigint")
    incoming = spark.createDataFrame([(2, 7, 1.5)], "id bigint, n int, extra double")
    for policies in ((S.PAUSE, S.IGNORE), (S.AUTO_APPLY, S.PAUSE)):
        with pytest.raises(S.SchemaPaused):
            S.evolve_schema(target, incoming, *policies)
    with pytest.raises(ValueError):
        S.evolve_schema(target, incoming, "maybe")
    wide, rows = S.evolve_schema(target, incoming, S.AUTO_APPLY, S.IGNORE)
    assert wide.unionByName(rows).orderBy("id").collect() == [(1, "a", 5, None), (2, None, 7, 1.5)]
    same, rows = S.evolve_schema(target, incoming, S.IGNORE, S.IGNORE)
    assert same.columns == rows.columns == ["id", "name", "n"] and rows.schema == same.schema
    with pytest.raises(S.SchemaPaused, match="changed from"):
        S.evolve_schema(target, target.withColumn("name", F.lit(1)), S.AUTO_APPLY, S.IGNORE)
    kept, rows = S.evolve_schema(target, target)
    assert kept.columns == target.columns
