"""Relational sources and sinks through Spark's JDBC reader and writer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesync.functions.names import check_raw_idents, normalize_tables, raw_ident
from tablesync.model import APPLIED, DEFAULT_RAW_PREFIX, DEFAULT_RAW_SCHEMA, select_as
from tablesync.operators.load import chunk_states, check_conflicts, load_report, raw_envelope, record_applied
from tablesync.session import local_frame, new_id, scratch_path


def quoted(table: str) -> str:
    first, second = normalize_tables([table])[0].split(".")
    return ".".join('"' + p.replace('"', '""') + '"' for p in (first, second))


def bounds_query(table: str, key: str) -> str:
    column = '"' + key.replace('"', '""') + '"'
    return f"SELECT MIN({column}) AS lo, MAX({column}) AS hi FROM {quoted(table)}"


def partition_options(key: str, lo, hi, partitions: int) -> dict[str, str]:
    """Reader options for a parallel scan over a numeric or time key."""
    return {
        "partitionColumn": '"' + key.replace('"', '""') + '"',
        "lowerBound": str(lo), "upperBound": str(hi), "numPartitions": str(partitions),
    }


def read_jdbc_table(
    spark: SparkSession, url: str, table: str, key: str | None = None, partitions: int = 1,
    predicates: list[str] | None = None, properties: dict | None = None,
) -> DataFrame:
    """A table as a DataFrame; filters on it are evaluated by the database.

    With a ``key`` the scan runs as ``partitions`` range queries between the key's bounds, with
    ``predicates`` as one query each.
    """
    properties = dict(properties or {})
    if predicates:
        return spark.read.jdbc(url, quoted(table), predicates=predicates, properties=properties)
    reader = spark.read.format("jdbc").options(url=url, dbtable=quoted(table), **properties)
    if key and partitions > 1:
        query = bounds_query(table, key)
        bounds = spark.read.format("jdbc").options(url=url, query=query, **properties).load().first()
        if bounds[0] is not None:
            reader = reader.options(**partition_options(key, bounds[0], bounds[1], partitions))
    return reader.load()


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def columns_query(tables) -> str:
    """Column catalog of the named tables from ``information_schema``."""
    pairs = [n.split(".") for n in normalize_tables(tables)]
    wanted = " OR ".join(
        f"(table_schema = {_text(s)} AND table_name = {_text(t)})" for s, t in pairs
    )
    return (
        "SELECT table_schema, table_name, ordinal_position, column_name, data_type, is_nullable "
        f"FROM information_schema.columns WHERE {wanted}"
    )


def primary_key_query(tables) -> str:
    """Key columns in key order from ``information_schema``."""
    pairs = [n.split(".") for n in normalize_tables(tables)]
    wanted = " OR ".join(
        f"(k.table_schema = {_text(s)} AND k.table_name = {_text(t)})" for s, t in pairs
    )
    return (
        "SELECT k.table_schema, k.table_name, k.ordinal_position, k.column_name "
        "FROM information_schema.table_constraints c "
        "JOIN information_schema.key_column_usage k ON k.constraint_name = c.constraint_name "
        "AND k.table_schema = c.table_schema AND k.table_name = c.table_name "
        f"WHERE c.constraint_type = 'PRIMARY KEY' AND ({wanted})"
    )


def _query(spark, url, query, properties) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, query=query, **(properties or {})).load()


def discover_jdbc_columns(spark, url, tables, properties=None) -> DataFrame:
    """Columns of database tables in ordinal order; a missing table is an error."""
    found = _query(spark, url, columns_query(tables), properties)
    rows = found.select(
        F.col("table_schema").alias("schema"), F.col("table_name").alias("name"),
        F.concat_ws(".", "table_schema", "table_name").alias("fully_qualified_name"),
        F.col("ordinal_position").cast("int").alias("ordinal"), "column_name", "data_type",
        (F.col("is_nullable") == "YES").alias("is_nullable"),
    )
    have = {r[0] for r in rows.select("fully_qualified_name").distinct().collect()}
    missing = [n for n in normalize_tables(tables) if n not in have]
    if missing:
        raise LookupError(f"table {missing[0]} was not found")
    return rows.orderBy("fully_qualified_name", "ordinal")


def discover_primary_key(spark, url, tables, properties=None) -> DataFrame:
    found = _query(spark, url, primary_key_query(tables), properties)
    return found.select(
        F.concat_ws(".", "table_schema", "table_name").alias("fully_qualified_name"),
        F.col("ordinal_position").cast("int").alias("ordinal"), "column_name",
    ).orderBy("fully_qualified_name", "ordinal")


def sink_options(url: str, table: str, batch_size: int, properties=None) -> dict[str, str]:
    if batch_size <= 0:
        raise ValueError(f"cannot send {batch_size} rows at a time")
    return {"url": url, "dbtable": table, "batchsize": str(batch_size), **(properties or {})}


def load_jdbc(
    chunks: DataFrame, read, url: str, schema: str = DEFAULT_RAW_SCHEMA,
    prefix: str = DEFAULT_RAW_PREFIX, batch_size: int = 100_000, replace: bool = False,
    properties: dict | None = None, applied: DataFrame | None = None, reader=None, writer=None,
) -> DataFrame:
    """Load chunks into raw tables of a database, each chunk once.

    Raw rows carry the load's id and are appended in parallel batches; the applied rows follow in
    one transaction and make them count. Rows of a load that died have an id that no applied row
    has, so a join with ``_applied_chunks`` on ``(object_key, _load_id)`` never shows them.
    ``applied`` replaces reading that table. A first load creates it, empty, before anything reads
    it. What became of every chunk is fixed before the first row is written, and rows are counted
    where they arrived. ``reader(table)`` and ``writer(rows, table)`` stand in for the database.
    """
    spark = chunks.sparkSession
    options = lambda table: sink_options(url, table, batch_size, properties)
    reader = reader or (lambda table: spark.read.format("jdbc").options(**options(table)).load())
    writer = writer or (lambda rows, table: rows.write.format("jdbc").options(**options(table)).mode("append").save())
    applied_table = f"{quoted(schema + '._applied_chunks')}"
    if applied is None:
        writer(local_frame(spark, [], APPLIED), applied_table)
        applied = reader(applied_table)
    path = scratch_path(spark, "chunk-states")  # one row per chunk
    chunk_states(chunks, select_as(applied, APPLIED)).write.parquet(path)
    states = spark.read.parquet(path)
    check_conflicts(states, replace)
    todo = states.filter("state <> 'applied'").drop("state")
    load_id = new_id()
    # One write per stream, a table each; every stream reads only its own files.
    streams = [r[0] for r in todo.select("stream_name").distinct().collect()]
    check_raw_idents(streams, prefix)
    counted = None
    for stream in streams:
        name = spark.range(1).select(raw_ident(stream, prefix)).first()[0]
        rows = raw_envelope(read(todo.filter(F.col("stream_name") == stream)), load_id)
        target = quoted(f"{schema}.{name}")
        writer(rows.drop("stream_name"), target)
        # A task that was tried twice may have written rows twice under one load.
        arrived = reader(target).filter(F.col("_load_id") == load_id).select("_object_key", "_row_number").distinct()
        counted = arrived if counted is None else counted.unionByName(arrived)
    if counted is None:
        return load_report(states, local_frame(spark, [], APPLIED), schema, prefix)
    path = scratch_path(spark, "applied-chunks")
    record_applied(todo, counted, load_id).write.parquet(path)
    done = spark.read.schema(APPLIED).parquet(path)
    writer(done.coalesce(1), applied_table)
    return load_report(states, done, schema, prefix)
