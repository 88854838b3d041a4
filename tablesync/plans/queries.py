"""The registered queries: every operator over the test tables, each with its SQL twin.

Streams, pipelines, runs and change logs are derived from the tables: customers stand for
pipelines, their orders for runs, line items for staged artifacts, events for status changes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.functions.codec import encode_rows, project_typed
from tablesync.functions.names import (
    chunk_key, normalize_prefix, raw_table_name, sanitize_name,
)
from tablesync.model import FULL, INCREMENTAL, LEDGER
from tablesync.operators import cdc, checkpoint, reconcile, runs, schema, writes
from tablesync.operators.chunking import SEQUENCE, capture_chunked, chunk_row_counts
from tablesync.operators.load import load_totals
from tablesync.plans.jobs import Capture, load_staging, replicate, snapshot_to_staging
from tablesync.plans.run_log import RunLog
from tablesync.session import local_frame, scratch_path
from tablesync.sources import capture
from tablesync.sources.keyed_table import KeyedTable
from tablesync.sources.ledger import load_ledger, save_ledger
from tablesync.sources.raw_store import RawStore
from tablesync.sources.staged import Staging, list_chunks, read_staged
from tablesync.streaming.changes import cdc_stream, cdc_table
from tablesync.streaming.loader import stream_load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

CHUNK = 5000
ORDERS, LINEITEM, EVENTS = "public.orders", "public.lineitem", "public.events"


def register(sql: str):
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        ORACLE[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _stage(spark, tables, pipeline="shop", ledger=None, **options):
    """Stage tables in a fresh area; returns the area and the staged result."""
    staging = Staging(scratch_path(spark, "staging"), pipeline, prefix="/daily/")
    ledger = local_frame(spark, [], LEDGER) if ledger is None else ledger
    return staging, snapshot_to_staging(spark, tables, staging, Capture(**options), ledger)


def _orders_staged(spark, sf):
    orders = table(spark, sf, "orders")
    staging, _ = _stage(
        spark, {ORDERS: orders}, chunk_size=CHUNK, keys={ORDERS: ["o_orderkey"]}
    )
    return orders, staging


# ------------------------------------------------------------ capture, encode, stage


@register("SELECT * FROM orders")
def snapshot_round_trip(spark, sf):
    """Orders captured, chunked, staged as gzipped JSON lines, loaded raw and typed back."""
    orders, staging = _orders_staged(spark, sf)
    store = RawStore(scratch_path(spark, "raw"))
    load_staging(spark, staging, store)
    return project_typed(store.read(spark, ORDERS), orders.schema)


@register("SELECT * FROM customer")
def snapshot_unchunked(spark, sf):
    """A whole table staged as one chunk of several files."""
    customer = table(spark, sf, "customer")
    staging, _ = _stage(spark, {"public.customer": customer}, batch_size=CHUNK)
    return project_typed(read_staged(spark, staging), customer.schema, "value")


@register("SELECT * FROM lineitem")
def unchunked_keyed_capture(spark, sf):
    """A table with a declared key staged as one chunk, straight from the scan."""
    lineitem = table(spark, sf, "lineitem")
    keys = {LINEITEM: ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]}
    staging, staged = _stage(spark, {LINEITEM: lineitem}, keys=keys)
    store = RawStore(scratch_path(spark, "raw"))
    load_staging(spark, staging, store)
    return project_typed(store.read(spark, LINEITEM), lineitem.schema)


@register("""
SELECT lang, part, length(wide) AS n, md5(wide) AS digest
FROM (SELECT lang, doc_id // 10000 AS part, string_agg(text, chr(10) ORDER BY doc_id) AS wide
      FROM documents GROUP BY ALL)""")
def wide_rows_round_trip(spark, sf):
    """All texts, those of a language and of 10,000 ids in one wide row, through staging and load."""
    part = F.expr("doc_id div 10000")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda t: t["text"])
    wide = table(spark, sf, "documents").groupBy("lang", part.alias("part")).agg(F.array_join(texts, "\n").alias("wide"))
    staging, _ = _stage(spark, {"public.wide": wide}, chunk_size=2)
    store = RawStore(scratch_path(spark, "raw"))
    load_staging(spark, staging, store)
    rows = project_typed(store.read(spark, "public.wide"), wide.schema)
    return rows.select("lang", "part", F.length("wide").cast("long").alias("n"), F.md5("wide").alias("digest"))


@register("SELECT * FROM orders")
def overlap_capped_runs(spark, sf):
    """Capped incremental runs that each read a month again; folded by key nothing is missing."""
    orders = table(spark, sf, "orders")
    staging, store = Staging(scratch_path(spark, "staging"), "shop"), RawStore(scratch_path(spark, "raw"))
    ledgers = scratch_path(spark, "ledger")
    options = Capture(INCREMENTAL, CHUNK, orders.count() // 3 + 1, "o_orderdate", "INTERVAL 30 DAY")
    for _ in range(4):
        replicate(spark, {ORDERS: orders}, staging, store, options, ledgers)
    return writes.latest_by_key(project_typed(store.read(spark, ORDERS), orders.schema), "o_orderkey", "o_orderdate")


@register(f"""
WITH t AS (SELECT 'public.customer' AS stream_name, count(*) AS n FROM customer
           UNION ALL SELECT 'public.orders', count(*) FROM orders)
SELECT stream_name, 'applied' AS status, n AS "rows", CAST(ceil(n / {CHUNK}.0) AS BIGINT) AS chunks,
       TRUE AS checkpoint_completed, 'succeeded' AS run_status, CAST(ceil(n / {CHUNK}.0) AS BIGINT) AS artifacts FROM t""")
def replicate_run_log(spark, sf):
    """The states a real run recorded, folded by the run reports."""
    tables = {f"public.{n}": table(spark, sf, n) for n in ("customer", "orders")}
    log = RunLog(scratch_path(spark, "log"))
    options = Capture(chunk_size=CHUNK, keys={"public.customer": ["c_custkey"], ORDERS: ["o_orderkey"]})
    replicate(
        spark, tables, Staging(scratch_path(spark, "staging"), "shop"), RawStore(scratch_path(spark, "raw")), options,
        scratch_path(spark, "ledger"), log=log,
    )
    status = runs.fold_run_status(log.read(spark, "status")).select("run_id", F.col("status").alias("run_status"))
    tables_done = runs.fold_table_executions(log.read(spark, "tables"))
    held = runs.list_artifacts(log.read(spark, "artifacts")).groupBy("stream_name").agg(F.count("*").alias("artifacts"))
    return tables_done.join(status, "run_id").join(held, "stream_name").select(
        "stream_name", "status", "rows", "chunks", "checkpoint_completed", "run_status", "artifacts"
    )


@register("SELECT * FROM orders")
def capped_then_resumed(spark, sf):
    """A capped run, then one that goes on above its last key with another chunk size."""
    orders = table(spark, sf, "orders")
    staging, store = Staging(scratch_path(spark, "staging"), "shop"), RawStore(scratch_path(spark, "raw"))
    ledgers, keys = scratch_path(spark, "ledger"), {ORDERS: ["o_orderkey"]}
    for options in (Capture(chunk_size=CHUNK, max_rows=700, keys=keys), Capture(chunk_size=CHUNK // 2, keys=keys)):
        replicate(spark, {ORDERS: orders}, staging, store, options, ledgers)
    return project_typed(store.read(spark, ORDERS), orders.schema)


@register("SELECT * FROM lineitem")
def snapshot_files(spark, sf):
    """A parquet table without a key, numbered by file position."""
    staging, _ = _stage(spark, {LINEITEM: f"{sf}/lineitem.parquet"}, chunk_size=CHUNK)
    return project_typed(read_staged(spark, staging), table(spark, sf, "lineitem").schema, "value")


LINE_ORDER = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]


@register(f"""
SELECT sequence, count(*) AS row_count, min(l_orderkey) AS first_order, max(l_orderkey) AS last_order
FROM (SELECT l_orderkey,
             (row_number() OVER (ORDER BY {', '.join(LINE_ORDER)}) - 1) // 5000 AS sequence
      FROM lineitem)
GROUP BY sequence""")
def snapshot_chunks(spark, sf):
    chunked = capture_chunked(table(spark, sf, "lineitem"), ["l_orderkey"] + LINE_ORDER[1:], CHUNK)
    return chunked.groupBy(SEQUENCE).agg(
        F.count("*").alias("row_count"), F.min("l_orderkey").alias("first_order"),
        F.max("l_orderkey").alias("last_order"),
    )


@register("""
SELECT 'daily/pipelines/shop/streams/public.orders/partitions/default/chunks/'
       || lpad(CAST(sequence AS VARCHAR), 20, '0') || '.jsonl.gz' AS object_key,
       count(*) AS row_count
FROM (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 5000 + 5 AS sequence FROM orders)
GROUP BY sequence""")
def chunk_keys(spark, sf):
    chunked = capture_chunked(table(spark, sf, "orders"), ["o_orderkey"], CHUNK, 5, unique=True)
    key = chunk_key("shop", ORDERS, F.col(SEQUENCE), prefix=" /daily// ")
    return chunk_row_counts(chunked).select(key.alias("object_key"), "row_count")


@register("""
SELECT url, trim(trim(url), '/') AS prefix, regexp_replace(url, '[^A-Za-z0-9_-]', '-', 'g') AS file_name
FROM pages""")
def clean_names(spark, sf):
    return table(spark, sf, "pages").select(
        "url", normalize_prefix(F.col("url")).alias("prefix"),
        sanitize_name(F.col("url")).alias("file_name"),
    )


@register("""
SELECT (rn - 1) // 5000 AS _sequence, (rn - 1) % 5000 + 1 AS _row_number, o_orderkey,
       'daily/pipelines/shop/streams/public.orders/partitions/default/chunks/'
       || lpad(CAST((rn - 1) // 5000 AS VARCHAR), 20, '0') || '.jsonl.gz' AS _object_key
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders)""")
def raw_envelope(spark, sf):
    orders, staging = _orders_staged(spark, sf)
    store = RawStore(scratch_path(spark, "raw"))
    load_staging(spark, staging, store)
    raw = store.read(spark, ORDERS)
    keep = ["_sequence", "_row_number", "_object_key"]
    return project_typed(raw, orders.schema, keep=keep).select(*keep, "o_orderkey")


@register("SELECT doc_id, text, lang, source, n_chars FROM documents")
def text_round_trip(spark, sf):
    """Line feeds, quotes and Unicode inside JSON lines."""
    documents = table(spark, sf, "documents")
    return project_typed(encode_rows(documents), documents.schema, "record")


@register("""
SELECT vec_id, label, i - 1 AS pos, CAST(embedding[i] AS DOUBLE) AS element
FROM (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)""")
def array_round_trip(spark, sf):
    embeddings = table(spark, sf, "embeddings")
    back = project_typed(encode_rows(embeddings), embeddings.schema, "record")
    exploded = back.select("vec_id", "label", F.posexplode("embedding").alias("pos", "element"))
    return exploded.withColumns(
        {"pos": F.col("pos").cast("bigint"), "element": F.col("element").cast("double")}
    )


@register("SELECT event_id, ts, user_id, event_type, value, CAST(props->>'k' AS BIGINT) AS k FROM events")
def embedded_json(spark, sf):
    """Microsecond times, and a JSON column embedded as an object instead of a quoted string."""
    events = table(spark, sf, "events")
    typed = T.StructType([
        T.StructField("props", T.StructType([T.StructField("k", T.LongType())]))
        if f.name == "props" else f for f in events.schema
    ])
    records = encode_rows(events, json_columns=["props"])
    return project_typed(records, typed, "record").select(
        "event_id", "ts", "user_id", "event_type", "value", F.col("props.k").alias("k")
    )


@register("SELECT * FROM orders ORDER BY o_orderkey LIMIT 500")
def snapshot_max_rows(spark, sf):
    return capture.capture_bounded(table(spark, sf, "orders"), "o_orderkey", 500)


@register("SELECT * FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01'")
def incremental_delta(spark, sf):
    return capture.capture_incremental(table(spark, sf, "orders"), "o_orderdate", "1998-01-01 00:00:00")


@register("SELECT * FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01' - INTERVAL 30 DAY")
def incremental_overlap(spark, sf):
    return capture.capture_incremental(
        table(spark, sf, "orders"), "o_orderdate", "1998-01-01 00:00:00", "INTERVAL 30 DAY"
    )


@register("""
SELECT * EXCLUDE (r) FROM (
  SELECT *, rank() OVER (ORDER BY o_orderdate) AS r FROM orders
  WHERE o_orderdate > TIMESTAMP '1998-01-01') WHERE r <= 500""")
def incremental_bounded(spark, sf):
    rows = capture.capture_incremental(table(spark, sf, "orders"), "o_orderdate", "1998-01-01 00:00:00")
    return capture.capture_capped(rows, "o_orderdate", 500)[0]


@register("""
SELECT 'public.lineitem' AS stream_name, count(*) AS row_count, sum(l_partkey)::BIGINT AS check_sum FROM lineitem
UNION ALL SELECT 'public.nation', count(*), sum(n_nationkey)::BIGINT FROM nation
UNION ALL SELECT 'public.part', count(*), sum(p_partkey)::BIGINT FROM part
UNION ALL SELECT 'public.supplier', count(*), sum(s_suppkey)::BIGINT FROM supplier""")
def multi_table_capture(spark, sf):
    keys = {"lineitem": "l_partkey", "nation": "n_nationkey", "part": "p_partkey", "supplier": "s_suppkey"}
    records = capture.capture_tables({f" public.{n} ": table(spark, sf, n) for n in keys})
    value = F.coalesce(*[F.get_json_object("record", f"$.{k}") for k in keys.values()])
    return records.groupBy("stream_name").agg(
        F.count("*").alias("row_count"), F.sum(value.cast("bigint")).alias("check_sum")
    )


@register("""
SELECT 'public.orders' AS table_name, (count(*) + 4999) // 5000 + 3 AS next_sequence, true AS finished,
       count(*) AS rows_emitted, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS max_cursor_value
FROM orders
UNION ALL
SELECT 'public.lineitem', (count(*) + 4999) // 5000 + 3, true, count(*),
       strftime(max(l_shipdate), '%Y-%m-%d %H:%M:%S') FROM lineitem
UNION ALL
SELECT 'public.events', (count(*) + 4999) // 5000 + 3, true, count(*), CAST(max(event_id) AS VARCHAR)
FROM events""")
def table_progress(spark, sf):
    out = None
    for name, stream, cursor in (
        ("orders", ORDERS, "o_orderdate"), ("lineitem", LINEITEM, "l_shipdate"), ("events", EVENTS, "event_id"),
    ):
        rows = table(spark, sf, name).select(cursor)
        chunked = capture_chunked(rows, [cursor], CHUNK, 3)
        row = checkpoint.table_progress(chunked, stream, 3, cursor).drop("cursor_type", "last_key")
        out = row if out is None else out.unionByName(row)
    return out


# ------------------------------------------------------------ ledger


@register("""
WITH chunks AS (
  SELECT 'public.orders' AS table_name, (row_number() OVER (ORDER BY o_orderkey) - 1) // 5000 AS seq FROM orders
  UNION ALL
  SELECT 'public.lineitem', (row_number() OVER () - 1) // 5000 FROM lineitem)
SELECT 'shop' AS pipeline_name, table_name, max(seq) + 1 AS next_sequence, count(*) AS rows_staged,
       'pipelines/shop/streams/' || table_name || '/partitions/default/chunks/'
       || lpad(CAST(max(seq) AS VARCHAR), 20, '0') || '.jsonl.gz' AS last_chunk_key,
       false AS completed
FROM chunks GROUP BY table_name""")
def checkpoint_fold(spark, sf):
    """Two rounds of staged chunks folded into one ledger, saved and read back in between."""
    parts = [
        chunk_row_counts(capture_chunked(table(spark, sf, name), [], CHUNK)).withColumn(
            "stream_name", F.lit(stream))
        for name, stream in (("orders", ORDERS), ("lineitem", LINEITEM))
    ]
    manifest = parts[0].unionByName(parts[1]).withColumns(
        {"pipeline_name": F.lit("shop"),
         "object_key": chunk_key("shop", F.col("stream_name"), F.col(SEQUENCE))}
    )
    root = scratch_path(spark, "ledger")
    early = F.col(SEQUENCE) < 3
    ledger = checkpoint.fold_checkpoint(load_ledger(spark, root, "shop"), manifest.filter(early))
    ledger = save_ledger(ledger, root, "shop")
    ledger = checkpoint.fold_checkpoint(ledger, manifest.filter(~early))
    return ledger.select(
        "pipeline_name", "table_name", "next_sequence", "rows_staged", "last_chunk_key", "completed"
    )


def _customer_ledger(spark, sf) -> DataFrame:
    """Customers as captured tables, orders as their chunks; machinery customers are complete."""
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    stream = F.format_string("crm.c%d", F.col("o_custkey"))
    manifest = orders.select(
        F.lit("shop").alias("pipeline_name"), stream.alias("stream_name"),
        F.col("o_orderkey").alias(SEQUENCE), F.floor("o_totalprice").cast("bigint").alias("row_count"),
        F.col("o_orderpriority").alias("object_key"),
    )
    ledger = checkpoint.fold_checkpoint(local_frame(spark, [], LEDGER), manifest)
    done = customer.filter("c_mktsegment = 'MACHINERY'").select(
        F.lit("shop").alias("pipeline_name"), F.format_string("crm.c%d", F.col("c_custkey")).alias("table_name")
    )
    return checkpoint.mark_complete(ledger, done)


_CUSTOMER_LEDGER = """
WITH staged AS (
  SELECT o_custkey, max(o_orderkey) + 1 AS next_sequence, sum(floor(o_totalprice))::BIGINT AS rows_staged
  FROM orders GROUP BY o_custkey),
ledger AS (
  SELECT coalesce(c_custkey, o_custkey) AS custkey, coalesce(next_sequence, 0) AS next_sequence,
         coalesce(rows_staged, 0) AS rows_staged, c_custkey IS NOT NULL AS completed
  FROM staged FULL JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')
    ON c_custkey = o_custkey)
"""


@register(_CUSTOMER_LEDGER + """
SELECT 'crm.c' || c_custkey AS table_name, coalesce(next_sequence, 0) AS start_sequence
FROM customer LEFT JOIN ledger ON custkey = c_custkey WHERE NOT coalesce(completed, false)""")
def pending_tables(spark, sf):
    requested = table(spark, sf, "customer").select(
        F.format_string("crm.c%d", F.col("c_custkey")).alias("table_name")
    )
    pending = checkpoint.pending_tables(requested, _customer_ledger(spark, sf), "shop", FULL)
    return pending.select("table_name", "start_sequence")


@register(_CUSTOMER_LEDGER + """
SELECT count(*) FILTER (completed) AS completed_tables, count(*) FILTER (NOT completed) AS resumable_tables,
       sum(rows_staged)::BIGINT AS rows_staged FROM ledger""")
def resume_summary(spark, sf):
    return checkpoint.resume_summary(_customer_ledger(spark, sf))


@register("""
SELECT 'crm.c' || o_custkey AS table_name, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS last_cursor_value
FROM orders GROUP BY o_custkey""")
def cursor_update(spark, sf):
    """Cursors overwritten by a newer run, and left alone by a run that saw none."""
    orders = table(spark, sf, "orders")
    base = orders.select(
        F.lit("shop").alias("pipeline_name"), F.format_string("crm.c%d", F.col("o_custkey")).alias("table_name"),
        "o_orderdate",
    )
    fold = lambda agg: base.groupBy("pipeline_name", "table_name").agg(
        agg("o_orderdate").cast("string").alias("cursor_value"))
    ledger = local_frame(spark, [], LEDGER)
    for agg in (F.min, F.max, lambda c: F.max(F.lit(None).cast("timestamp_ntz"))):
        ledger = checkpoint.update_cursor(ledger, fold(agg))
    return ledger.select("table_name", "last_cursor_value")


# ------------------------------------------------------------ load


def _two_runs(spark, sf):
    """Orders staged by two incremental runs; the first one's chunks are loaded beforehand."""
    orders = table(spark, sf, "orders")
    staging = Staging(scratch_path(spark, "staging"), "shop", prefix="daily")
    options = Capture(INCREMENTAL, CHUNK, cursor="o_orderdate", keys={ORDERS: ["o_orderkey"]})
    store = RawStore(scratch_path(spark, "raw"))
    early = orders.filter("o_orderdate <= timestamp_ntz '1998-01-01'")
    first = snapshot_to_staging(
        spark, {ORDERS: early}, staging, options, local_frame(spark, [], LEDGER)
    )
    load_staging(spark, staging, store)
    snapshot_to_staging(spark, {ORDERS: orders}, staging, options, first.ledger)
    return orders, staging, store


_TWO_RUNS = """
WITH runs AS (
  SELECT o_orderdate > TIMESTAMP '1998-01-01' AS late,
         (row_number() OVER (PARTITION BY o_orderdate > TIMESTAMP '1998-01-01'
                             ORDER BY o_orderdate, o_orderkey) - 1) // 5000 AS n FROM orders),
first AS (SELECT max(n) + 1 AS chunks FROM runs WHERE NOT late),
chunks AS (
  SELECT CASE WHEN late THEN n + (SELECT chunks FROM first) ELSE n END AS sequence, late, count(*) AS rows
  FROM runs GROUP BY late, n)
"""
_KEY = """'daily/pipelines/shop/streams/public.orders/partitions/default/chunks/'
  || lpad(CAST(sequence AS VARCHAR), 20, '0') || '.jsonl.gz' AS object_key"""


@register(_TWO_RUNS + f"""
SELECT {_KEY}, '"tablesync_raw"."raw_public_orders"' AS table_name,
       CASE WHEN late THEN rows ELSE 0 END AS rows_written, NOT late AS skipped FROM chunks""")
def load_report(spark, sf):
    _, staging, store = _two_runs(spark, sf)
    return load_staging(spark, staging, store)


@register(_TWO_RUNS + """
SELECT count(*) FILTER (late) AS chunks_applied, (sum(rows) FILTER (late))::BIGINT AS rows_written,
       count(*) FILTER (NOT late) AS chunks_skipped FROM chunks""")
def load_totals_report(spark, sf):
    _, staging, store = _two_runs(spark, sf)
    return load_totals(load_staging(spark, staging, store))


@register(_TWO_RUNS + f"""
SELECT {_KEY}, 'shop' AS pipeline_name, 'public.orders' AS stream_name, sequence, rows AS row_count FROM chunks""")
def applied_chunks(spark, sf):
    _, staging, store = _two_runs(spark, sf)
    load_staging(spark, staging, store)
    return store.applied(spark).select(
        "object_key", "pipeline_name", "stream_name", "sequence", "row_count"
    )


@register("SELECT * FROM orders")
def incremental_load(spark, sf):
    """Two incremental runs together load every row once."""
    orders, staging, store = _two_runs(spark, sf)
    load_staging(spark, staging, store)
    return project_typed(store.read(spark, ORDERS), orders.schema)


@register(_TWO_RUNS + f"""
SELECT 'public.orders' AS stream_name, sequence, rows AS row_count, {_KEY} FROM chunks""")
def list_staged_chunks(spark, sf):
    _, staging, _ = _two_runs(spark, sf)
    return list_chunks(spark, staging).select("stream_name", SEQUENCE, "row_count", "object_key")


@register("""
SELECT url, '"tablesync_raw"."raw_' || trim(lower(regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g')), '_') || '"'
       AS table_name FROM pages""")
def raw_table_names(spark, sf):
    return table(spark, sf, "pages").select("url", raw_table_name(F.col("url")).alias("table_name"))


# ------------------------------------------------------------ schema

# Columns of the test tables, for the SQL twin of the column catalog.
_TABLE_COLUMNS = {
    "benchmark": "item_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "labels": "doc_id bigint, quality int, toxic int",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "pages": "page_id bigint, url string, html string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "region": "r_regionkey int, r_name string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
}


def _catalog_sql() -> str:
    rows = []
    for name, columns in _TABLE_COLUMNS.items():
        for i, part in enumerate(columns.split(", "), 1):
            column, dtype = part.split(" ", 1)
            rows.append(
                f"SELECT 'public' AS schema, '{name}' AS name, 'public.{name}' AS fully_qualified_name, "
                f"{i} AS ordinal, '{column}' AS column_name, '{dtype}' AS data_type, "
                f"bool_or({column} IS NULL) AS is_nullable FROM {name}"
            )
    return "\nUNION ALL ".join(rows)


@register(_catalog_sql())
def discover_columns(spark, sf):
    tables = {f"public.{n}": table(spark, sf, n) for n in _TABLE_COLUMNS}
    return schema.discover_columns(tables, observe_nulls=True)


@register("""
SELECT l_orderkey, l_linenumber, count(*) AS row_count, 'duplicate' AS problem
FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def verify_key(spark, sf):
    return schema.verify_key(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@register("""
SELECT c_custkey AS position, 'n' || c_nationkey || '.' || lower(c_mktsegment) AS table_name FROM customer
WHERE c_nationkey || lower(c_mktsegment) NOT IN (
  SELECT s_nationkey || CASE WHEN s_acctbal > 0 THEN 'machinery' ELSE 'household' END FROM supplier)""")
def missing_tables(spark, sf):
    requested = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("position"),
        F.format_string("n%d.%s", "c_nationkey", F.lower("c_mktsegment")).alias("table_name"),
    )
    kind = F.when(F.col("s_acctbal") > 0, "machinery").otherwise("household")
    catalog = table(spark, sf, "supplier").select(
        F.format_string("n%d.%s", "s_nationkey", kind).alias("fully_qualified_name")
    )
    return schema.missing_tables(requested, catalog)


@register("""
SELECT source || '.doc"' || doc_id AS table, 'SELECT * FROM "' || source || '"."doc""' || doc_id || '"' AS sql,
       CAST(5000 AS BIGINT) AS chunk_size, 'full' AS mode FROM documents""")
def snapshot_plan(spark, sf):
    names = table(spark, sf, "documents").select(
        F.format_string('%s.doc"%d', "source", "doc_id").alias("table_name")
    )
    return schema.snapshot_plan(names, CHUNK)


@register("""
SELECT (rn - 1) // 5000 AS sequence, count(*) AS row_count,
       sha256('o_orderkey:bigint:true' || chr(10) || 'o_custkey:bigint:true' || chr(10)
         || 'o_orderstatus:string:true' || chr(10) || 'o_totalprice:double:true' || chr(10)
         || 'o_orderdate:timestamp_ntz:true' || chr(10) || 'o_orderpriority:string:true') AS schema_fingerprint
FROM (SELECT row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) GROUP BY (rn - 1) // 5000""")
def schema_fingerprint(spark, sf):
    """Every staged chunk carries the fingerprint of its table's schema."""
    _, staging = _orders_staged(spark, sf)
    return list_chunks(spark, staging).select(SEQUENCE, "row_count", "schema_fingerprint")


@register("""
WITH old AS (SELECT 'app.u' || user_id AS stream, event_type AS "column",
                    CASE WHEN max(value) > 100 THEN 'bigint' ELSE 'int' END AS old_type
             FROM events WHERE ts < TIMESTAMP '2024-01-10' GROUP BY ALL),
     new AS (SELECT 'app.u' || user_id AS stream, event_type AS "column",
                    CASE WHEN max(value) > 100 THEN 'bigint' ELSE 'int' END AS new_type
             FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY ALL)
SELECT stream, "column", old_type, new_type,
       CASE WHEN old_type IS NULL THEN 'additive'
            WHEN new_type IS NULL OR old_type = 'bigint' THEN 'breaking' ELSE 'unknown' END AS change_type,
       CASE WHEN old_type IS NULL THEN 'auto_applied'
            WHEN new_type IS NULL OR old_type = 'bigint' THEN 'paused' ELSE 'detected' END AS resolution
FROM old FULL JOIN new USING (stream, "column") WHERE old_type IS DISTINCT FROM new_type""")
def schema_diff(spark, sf):
    """Drift between two column catalogs: what each user's events held before and after a date."""
    events = table(spark, sf, "events")

    def catalog(rows):
        return rows.groupBy("user_id", "event_type").agg(
            F.when(F.max("value") > 100, "bigint").otherwise("int").alias("data_type")
        ).select(
            F.format_string("app.u%d", "user_id").alias("fully_qualified_name"),
            F.col("event_type").alias("column_name"), "data_type",
        )

    before = F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz")
    return schema.schema_diff(
        catalog(events.filter(before)), catalog(events.filter(~before)), schema.AUTO_APPLY, schema.PAUSE
    )


@register("""
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, CAST(NULL AS VARCHAR) AS c_tier FROM customer
UNION ALL
SELECT c_custkey + 1000000, c_name, c_nationkey, c_acctbal, NULL,
       CASE WHEN c_acctbal > 5000 THEN 'gold' ELSE 'basic' END FROM customer""")
def evolve_schema(spark, sf):
    """A column added, a column removed and a narrowed one, under auto-apply and ignore."""
    customer = table(spark, sf, "customer")
    incoming = customer.select(
        (F.col("c_custkey") + 1000000).alias("c_custkey"), "c_name",
        F.col("c_nationkey").cast("smallint").alias("c_nationkey"), "c_acctbal",
        F.when(F.col("c_acctbal") > 5000, "gold").otherwise("basic").alias("c_tier"),
    )
    target, rows = schema.evolve_schema(customer, incoming, schema.AUTO_APPLY, schema.IGNORE)
    return writes.write_append(target, rows)


# ------------------------------------------------------------ write modes


def _order_updates(spark, sf) -> DataFrame:
    """Line items as updates of their orders; returned ones are deletes."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("o_custkey"),
        F.col("l_linestatus").alias("o_orderstatus"), F.col("l_extendedprice").alias("o_totalprice"),
        F.col("l_shipdate").alias("o_orderdate"), F.col("l_returnflag").alias("o_orderpriority"),
        F.when(F.col("l_returnflag") == "R", "D").otherwise("U").alias("op"),
    )


_UPDATE_ORDER = ["o_orderdate", "o_totalprice", "o_custkey", "o_orderstatus", "o_orderpriority"]
_UPDATES = """
WITH target AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'),
newest AS (
  SELECT l_orderkey AS o_orderkey, l_partkey AS o_custkey, l_linestatus AS o_orderstatus,
         l_extendedprice AS o_totalprice, l_shipdate AS o_orderdate, l_returnflag AS o_orderpriority
  FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_extendedprice DESC,
                             l_partkey DESC, l_linestatus DESC, l_returnflag DESC) = 1)
"""


def _order_target(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").filter("o_orderdate < timestamp_ntz '1998-01-01'")


@register("SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'")
def write_append(spark, sf):
    return writes.write_append(table(spark, sf, "orders"), _order_target(spark, sf))


@register(_UPDATES + """
SELECT * FROM target WHERE o_orderkey NOT IN (SELECT o_orderkey FROM newest)
UNION ALL SELECT * FROM newest""")
def write_upsert(spark, sf):
    return writes.write_upsert(
        _order_target(spark, sf), _order_updates(spark, sf), "o_orderkey", _UPDATE_ORDER
    )


_MERGED = _UPDATES + """
SELECT * FROM target WHERE o_orderkey NOT IN (SELECT o_orderkey FROM newest)
UNION ALL SELECT * FROM newest WHERE o_orderpriority <> 'R'"""


@register(_MERGED)
def write_merge(spark, sf):
    return writes.write_merge(
        _order_target(spark, sf), _order_updates(spark, sf), "o_orderkey", _UPDATE_ORDER
    )


@register(_MERGED)
def keyed_table_merge(spark, sf):
    """The same merge into a stored table, rewriting touched buckets only."""
    target = _order_target(spark, sf)
    stored = KeyedTable(scratch_path(spark, "keyed"), ("o_orderkey",), target.schema, 8)
    stored.replace(target)
    stored.merge(_order_updates(spark, sf), _UPDATE_ORDER)
    return stored.read(spark)


@register(_MERGED)
def keyed_table_rebucketed(spark, sf):
    """The merge repeated after the stored table was cut into more buckets."""
    target, updates = _order_target(spark, sf), _order_updates(spark, sf)
    stored = KeyedTable(scratch_path(spark, "keyed"), ("o_orderkey",), target.schema, 8)
    stored.replace(target)
    stored.merge(updates, _UPDATE_ORDER)
    stored = stored.rebucket(spark, 32)
    stored.merge(updates, _UPDATE_ORDER)
    return stored.read(spark)


@register("SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'")
def write_replace(spark, sf):
    """A stored table's contents swapped as one unit."""
    orders = table(spark, sf, "orders")
    stored = KeyedTable(scratch_path(spark, "keyed"), ("o_orderkey",), orders.schema, 8)
    stored.replace(orders)
    stored.replace(writes.write_replace(orders, _order_target(spark, sf)))
    return stored.read(spark)


@register("""
SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_by_key(spark, sf):
    return writes.latest_by_key(table(spark, sf, "events"), "user_id", ["ts", "event_id"])


# ------------------------------------------------------------ reconciliation


def _damaged_orders(spark, sf) -> DataFrame:
    """Orders with the urgent ones lost, the low ones repriced, and some keys added."""
    orders = table(spark, sf, "orders")
    kept = orders.filter("o_orderpriority <> '1-URGENT'").withColumn(
        "o_totalprice",
        F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")),
    )
    added = orders.filter("o_orderstatus = 'P'").withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000)
    return kept.unionByName(added)


_DAMAGED = """
WITH damaged AS (
  SELECT o_orderkey, o_custkey, o_orderstatus,
         CASE WHEN o_orderpriority = '5-LOW' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
         o_orderdate, o_orderpriority
  FROM orders WHERE o_orderpriority <> '1-URGENT'
  UNION ALL
  SELECT o_orderkey + 10000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
  FROM orders WHERE o_orderstatus = 'P')
"""


@register(_DAMAGED + """
SELECT table_name, coalesce(e, 0) AS expected, coalesce(a, 0) AS actual, coalesce(e, 0) = coalesce(a, 0) AS ok
FROM (SELECT o_orderpriority AS table_name, count(*) AS e FROM orders GROUP BY 1)
FULL JOIN (SELECT o_orderpriority AS table_name, count(*) AS a FROM damaged GROUP BY 1) USING (table_name)""")
def reconcile_counts(spark, sf):
    name = F.col("o_orderpriority").alias("table_name")
    return reconcile.reconcile_counts(
        table(spark, sf, "orders").select(name), _damaged_orders(spark, sf).select(name)
    )


@register(_DAMAGED + """
SELECT coalesce(o.o_orderkey, d.o_orderkey) AS o_orderkey,
       CASE WHEN d.o_orderkey IS NULL THEN 'missing' WHEN o.o_orderkey IS NULL THEN 'extra' ELSE 'changed' END AS status,
       CAST(o.o_orderkey IS NOT NULL AS BIGINT) AS source_rows, CAST(d.o_orderkey IS NOT NULL AS BIGINT) AS dest_rows
FROM orders o FULL JOIN damaged d ON o.o_orderkey = d.o_orderkey
WHERE o.o_orderkey IS NULL OR d.o_orderkey IS NULL OR o.o_totalprice <> d.o_totalprice""")
def reconcile_rows(spark, sf):
    return reconcile.reconcile_rows(table(spark, sf, "orders"), _damaged_orders(spark, sf), "o_orderkey")


# ------------------------------------------------------------ change log


def _changes(events: DataFrame) -> DataFrame:
    """Events as changes of the customer table: errors delete, signups insert."""
    op = F.when(F.col("event_type") == "error", "D").when(F.col("event_type") == "signup", "I").otherwise("U")
    return events.select(
        op.alias("op"), F.col("event_id").alias("lsn"), F.col("user_id").alias("c_custkey"),
        F.concat(F.lit("Customer-"), F.col("event_type")).alias("c_name"),
        F.lit(1).alias("c_nationkey"), F.col("value").alias("c_acctbal"), F.col("event_type").alias("c_mktsegment"),
    )


_CHANGES = """
WITH changes AS (
  SELECT CASE event_type WHEN 'error' THEN 'D' WHEN 'signup' THEN 'I' ELSE 'U' END AS op, event_id AS lsn,
         user_id AS c_custkey, 'Customer-' || event_type AS c_name, 1 AS c_nationkey, value AS c_acctbal,
         event_type AS c_mktsegment FROM events),
newest AS (SELECT * FROM changes QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY lsn DESC) = 1)
"""
_APPLIED = _CHANGES + """
SELECT * FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM newest WHERE lsn > 100)
UNION ALL
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM newest WHERE op <> 'D' AND lsn > 100"""


@register(_CHANGES + "SELECT * FROM newest")
def cdc_latest(spark, sf):
    changes = cdc.read_change_log(_changes(table(spark, sf, "events")), "c_custkey")
    return cdc.cdc_latest(changes, "c_custkey")


@register(_APPLIED)
def cdc_apply(spark, sf):
    return cdc.cdc_apply(
        table(spark, sf, "customer"), _changes(table(spark, sf, "events")), "c_custkey", 100
    )


@register("""
WITH c AS (SELECT event_type AS stream_name, max(event_id) AS last_lsn FROM events GROUP BY 1),
l AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'click' ELSE o_orderstatus END AS stream_name,
             max(o_orderkey) AS k FROM orders GROUP BY 1)
SELECT stream_name, CAST(last_lsn AS VARCHAR) AS last_lsn, CAST(k AS VARCHAR) AS last_snapshot_chunk,
       CASE WHEN last_lsn IS NOT NULL THEN 'cdc_running' ELSE 'snapshot_complete' END AS phase
FROM c FULL JOIN l USING (stream_name)""")
def cdc_progress(spark, sf):
    changes = table(spark, sf, "events").select(
        F.col("event_type").alias("stream_name"), F.col("event_id").alias("lsn")
    )
    stream = F.when(F.col("o_orderstatus") == "F", "click").otherwise(F.col("o_orderstatus"))
    ledger = table(spark, sf, "orders").groupBy(stream.alias("table_name")).agg(
        F.max("o_orderkey").cast("string").alias("last_chunk_key"), F.lit(True).alias("completed")
    )
    progress = cdc.cdc_progress(changes, ledger)
    return progress.withColumn("last_lsn", F.col("last_lsn").cast("string"))


# ------------------------------------------------------------ streaming


@register("SELECT * FROM orders")
def stream_load_orders(spark, sf):
    """Chunks of two runs loaded by a stream that is started twice."""
    orders = table(spark, sf, "orders")
    staging = Staging(scratch_path(spark, "staging"), "shop")
    store = RawStore(scratch_path(spark, "raw"))
    progress = scratch_path(spark, "stream")
    options = Capture(INCREMENTAL, CHUNK, cursor="o_orderdate", keys={ORDERS: ["o_orderkey"]})
    early = orders.filter("o_orderdate <= timestamp_ntz '1998-01-01'")
    ledger = local_frame(spark, [], LEDGER)
    for part in (early, orders):
        ledger = snapshot_to_staging(spark, {ORDERS: part}, staging, options, ledger).ledger
        stream_load(spark, staging, store, progress).awaitTermination()
    return project_typed(store.read(spark, ORDERS), orders.schema)


@register("SELECT * FROM orders")
def stream_load_restaged(spark, sf):
    """A capture staged twice before one trigger, as after a crash before the ledger was saved."""
    orders = table(spark, sf, "orders")
    staging = Staging(scratch_path(spark, "staging"), "shop")
    store = RawStore(scratch_path(spark, "raw"))
    options = Capture(chunk_size=CHUNK, keys={ORDERS: ["o_orderkey"]})
    for _ in range(2):
        snapshot_to_staging(spark, {ORDERS: orders}, staging, options, local_frame(spark, [], LEDGER))
    stream_load(spark, staging, store, scratch_path(spark, "stream")).awaitTermination()
    return project_typed(store.read(spark, ORDERS), orders.schema)


_LATE = _CHANGES + """
SELECT * FROM customer WHERE c_acctbal >= 0 AND c_custkey NOT IN (SELECT c_custkey FROM newest WHERE lsn > 100)
UNION ALL
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM newest WHERE op <> 'D' AND lsn > 100"""


@register(_LATE)
def stream_cdc_late_keys(spark, sf):
    """A snapshot that lacks many of the changed keys; changes it contains already are left out."""
    customer, events = table(spark, sf, "customer").filter("c_acctbal >= 0"), table(spark, sf, "events")
    stored = cdc_table(scratch_path(spark, "cdc"), "c_custkey", customer.schema, 8)
    changes = _changes(spark.readStream.schema(events.schema).parquet(f"{sf}/events*.parquet"))
    progress = scratch_path(spark, "stream")
    cdc_stream(changes, stored, progress, FULL, customer, 100).awaitTermination()
    cdc_stream(changes, stored, progress, FULL, customer, 100).awaitTermination()
    return stored.read(spark).drop("_lsn", "_deleted")


@register(_APPLIED)
def stream_cdc(spark, sf):
    """Customers backfilled, then kept up from the event stream; the second start finds nothing."""
    customer, events = table(spark, sf, "customer"), table(spark, sf, "events")
    stored = cdc_table(scratch_path(spark, "cdc"), "c_custkey", customer.schema, 8)
    changes = _changes(spark.readStream.schema(events.schema).parquet(f"{sf}/events*.parquet"))
    progress = scratch_path(spark, "stream")
    cdc_stream(changes, stored, progress, FULL, customer, 100).awaitTermination()
    cdc_stream(changes, stored, progress).awaitTermination()
    return stored.read(spark).drop("_lsn", "_deleted")


# ------------------------------------------------------------ run history


def _pipelines(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("postgres").alias("source_kind"),
        F.lower("c_mktsegment").alias("destination_kind"),
        F.when(F.col("c_acctbal") < 0, "paused").otherwise("active").alias("status"),
        F.col("c_custkey").alias("active_spec_id"),
    )


def _runs(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("pipeline_id"),
        F.col("o_orderdate").alias("started_at"), F.col("o_orderdate").alias("created_at"),
        F.col("o_orderstatus").alias("status"),
    )


_RUNS = """
SELECT o_orderkey AS id, o_custkey AS pipeline_id, o_orderdate AS started_at, o_orderdate AS created_at,
       o_orderstatus AS status, c_name AS pipeline_name FROM orders JOIN customer ON c_custkey = o_custkey
"""


@register("""
SELECT c_name AS name, 'postgres' AS source_kind, lower(c_mktsegment) AS destination_kind,
       CASE WHEN c_acctbal < 0 THEN 'paused' ELSE 'active' END AS status, coalesce(p_size, 0) AS spec_version
FROM customer LEFT JOIN part ON p_partkey = c_custkey""")
def pipelines_overview(spark, sf):
    specs = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("version"))
    return runs.pipelines_overview(_pipelines(spark, sf), specs)


@register(_RUNS)
def run_list(spark, sf):
    return runs.run_list(_runs(spark, sf), _pipelines(spark, sf))


@register(_RUNS + """
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def latest_run(spark, sf):
    return runs.latest_run(_runs(spark, sf), _pipelines(spark, sf))


@register(f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pipeline_id ORDER BY started_at DESC, id DESC)::INT AS position
               FROM ({_RUNS})) WHERE position <= 10""")
def run_history(spark, sf):
    return runs.run_history(_runs(spark, sf), _pipelines(spark, sf))


# What each event type stands for in the status log.
_STATUS = {"click": "running", "view": "staged", "purchase": "succeeded", "error": "failed", "signup": "queued"}


def _status(column="event_type"):
    out = F.lit(None).cast("string")
    for kind, status in _STATUS.items():
        out = F.when(F.col(column) == kind, status).otherwise(out)
    return out


_STATUS_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATUS.items()) + " END"


@register(f"""
SELECT user_id AS run_id, arg_max({_STATUS_SQL}, event_id) AS status,
       max(ts) FILTER (event_type IN ('purchase', 'error')) AS finished_at, max(ts) AS updated_at,
       arg_max(event_type, event_id) AS phase, arg_max(CAST(props->>'k' AS BIGINT), event_id) AS k,
       arg_max(event_id, event_id) AS progress
FROM events GROUP BY user_id""")
def run_status(spark, sf):
    log = table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), "ts", "event_id", _status().alias("status"),
        F.col("props").alias("stats_json"), F.col("event_type").alias("phase"),
        F.col("event_id").alias("progress_current"), F.lit(None).cast("bigint").alias("progress_total"),
    )
    folded = runs.fold_run_status(log)
    return folded.select(
        "run_id", "status", "finished_at", "updated_at",
        F.get_json_object("stats_json", "$.phase").alias("phase"),
        F.get_json_object("stats_json", "$.k").cast("bigint").alias("k"),
        F.get_json_object("stats_json", "$.progress.current").cast("bigint").alias("progress"),
    )


@register(f"""
SELECT user_id AS run_id, 's' || (event_id // 1000) AS stream_name, arg_max({_STATUS_SQL}, event_id) AS status,
       arg_max(CAST(floor(value) AS BIGINT), event_id) AS rows_processed,
       coalesce(arg_max(CASE WHEN event_type = 'purchase' THEN 1 WHEN event_type = 'click' THEN 0 ELSE -1 END, event_id) = 1, false)
         AS checkpoint_completed,
       min(ts) AS started_at, max(ts) FILTER (event_type IN ('view', 'error')) AS finished_at, max(ts) AS updated_at
FROM events GROUP BY ALL""")
def table_executions(spark, sf):
    kind = F.col("event_type")
    log = table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), F.format_string("s%d", F.expr("event_id div 1000")).alias("stream_name"),
        "ts", "event_id", _status().alias("status"), F.floor("value").cast("bigint").alias("rows_processed"),
        F.when(kind == "purchase", True).when(kind == "click", False).alias("checkpoint_completed"),
    )
    return runs.list_table_executions(runs.fold_table_executions(log))


def _artifacts(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("pipeline_run_id"), F.col("l_suppkey").cast("string").alias("stream_name"),
        F.col("l_linestatus").alias("partition_key"), F.col("l_linenumber").alias(SEQUENCE),
        F.col("l_partkey").cast("string").alias("object_key"),
    )


@register("""
SELECT l_orderkey AS pipeline_run_id, CAST(l_suppkey AS VARCHAR) AS stream_name, l_linestatus AS partition_key,
       l_linenumber AS sequence, CAST(l_partkey AS VARCHAR) AS object_key FROM lineitem""")
def artifacts(spark, sf):
    return runs.list_artifacts(_artifacts(spark, sf))


@register("""
SELECT l_orderkey AS pipeline_run_id, 'object_key' AS rule, count(*) AS row_count
FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(*) > 1
UNION ALL
SELECT l_orderkey, 'sequence', count(*) FROM lineitem
GROUP BY l_orderkey, l_suppkey, l_linestatus, l_linenumber HAVING count(*) > 1""")
def artifact_duplicates(spark, sf):
    return runs.duplicate_artifacts(_artifacts(spark, sf))


@register("""
WITH marked AS (
  SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
SELECT CAST(user_id AS VARCHAR) AS pipeline_name, event_id AS apply_id, ts AS applied_at,
       sha256(event_type) AS content_hash, prev IS DISTINCT FROM event_type AS new_version,
       (sum(CAST(prev IS DISTINCT FROM event_type AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS version
FROM marked""")
def spec_versions(spark, sf):
    applies = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("pipeline_name"), F.col("ts").alias("applied_at"),
        F.col("event_id").alias("apply_id"), F.col("event_type").alias("spec_text"),
    )
    return runs.spec_versions(applies)


@register("""
WITH gone AS (SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey
              WHERE c_name = 'Customer#000000042')
SELECT 'pipelines' AS kind, count(*) AS left_rows FROM customer WHERE c_name <> 'Customer#000000042'
UNION ALL SELECT 'specs', count(*) FROM part WHERE p_partkey <> 42
UNION ALL SELECT 'runs', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT * FROM gone)
UNION ALL SELECT 'artifacts', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT * FROM gone)
UNION ALL SELECT 'executions', count(*) FROM events WHERE user_id NOT IN (SELECT * FROM gone)""")
def drop_pipeline(spark, sf):
    left = runs.drop_pipeline(
        "Customer#000000042", _pipelines(spark, sf),
        table(spark, sf, "part").select(F.col("p_partkey").alias("pipeline_id"), "p_size"),
        _runs(spark, sf), _artifacts(spark, sf),
        table(spark, sf, "events").select(F.col("user_id").alias("pipeline_run_id"), "event_type"),
    )
    out = None
    for kind, rows in left.items():
        row = rows.agg(F.lit(kind).alias("kind"), F.count("*").alias("left_rows"))
        out = row if out is None else out.unionByName(row)
    return out


@register("""
WITH r AS (SELECT event_id AS id, ts AS started_at, user_id AS rows_processed,
                  CASE WHEN event_type = 'click' THEN NULL
                       ELSE ts + to_milliseconds(CAST(floor(value * 4000) AS BIGINT)) END AS finished_at,
                  CASE WHEN event_type = 'view' THEN NULL ELSE event_id END AS rows_total FROM events),
d AS (SELECT *, epoch_ms(finished_at) - epoch_ms(started_at) AS duration_ms FROM r)
SELECT id, started_at, finished_at, rows_processed, CAST(rows_total AS VARCHAR) AS rows_total,
       CAST(duration_ms AS VARCHAR) AS duration_ms,
       CASE WHEN duration_ms IS NULL THEN '—' WHEN duration_ms < 1000 THEN duration_ms || 'ms'
            WHEN duration_ms < 60000 THEN CAST(floor(duration_ms / 1000.0 + 0.5) AS BIGINT) || 's'
            ELSE CAST(floor(duration_ms / 60000.0 + 0.5) AS BIGINT) || 'm' END AS duration,
       format('{:,}', rows_processed)
         || CASE WHEN rows_total IS NULL THEN ' rows' ELSE ' / ' || format('{:,}', rows_total) || ' rows' END AS row_progress
FROM d""")
def run_durations(spark, sf):
    events = table(spark, sf, "events")
    finish = F.col("ts") + F.make_dt_interval(secs=F.floor(F.col("value") * 4000).cast("decimal(18,6)") / 1000)
    log = events.select(
        F.col("event_id").alias("id"), F.col("ts").alias("started_at"),
        F.when(F.col("event_type") != "click", finish).alias("finished_at"),
        F.col("user_id").alias("rows_processed"),
        F.when(F.col("event_type") != "view", F.col("event_id")).alias("rows_total"),
    )
    return runs.run_durations(log).withColumns(
        {c: F.col(c).cast("string") for c in ("rows_total", "duration_ms")}
    )


# The error kind each event type stands for.
_KINDS = {"click": "connection_failed", "view": "query_failed", "purchase": "staging_failed",
          "error": "internal", "signup": "not_found"}


@register("""
SELECT event_id, CASE event_type WHEN 'click' THEN 'CONNECTION_FAILED' WHEN 'view' THEN 'QUERY_FAILED'
         WHEN 'purchase' THEN 'STAGING_FAILED' WHEN 'error' THEN 'INTERNAL_ERROR' ELSE 'NOT_FOUND' END AS error_code,
       event_type IN ('click', 'view', 'purchase') AND value > 50 AS is_retryable FROM events""")
def classify_errors(spark, sf):
    pairs = [F.lit(x) for kv in _KINDS.items() for x in kv]
    log = table(spark, sf, "events").select(
        "event_id", F.create_map(*pairs)[F.col("event_type")].alias("error_kind"),
        (F.col("value") > 50).alias("retryable"),
    )
    return runs.classify_errors(log).select("event_id", "error_code", "is_retryable")


# ------------------------------------------------------------ whole jobs


@register("""
SELECT 'raw_public_nation' AS raw_table, count(*) AS row_count, (count(*) + 4999) // 5000 AS chunks FROM nation
UNION ALL SELECT 'raw_public_customer', count(*), (count(*) + 4999) // 5000 FROM customer
UNION ALL SELECT 'raw_public_orders', count(*), (count(*) + 4999) // 5000 FROM orders
UNION ALL SELECT 'raw_public_lineitem', count(*), (count(*) + 4999) // 5000 FROM lineitem""")
def replicate_tables(spark, sf):
    """Four tables replicated twice, two at a time; the second run adds nothing."""
    keys = {"nation": ["n_nationkey"], "customer": ["c_custkey"], "orders": ["o_orderkey"], "lineitem": []}  # line items have no key
    tables = {f"public.{n}": f"{sf}/{n}.parquet" for n in keys}
    options = Capture(
        chunk_size=CHUNK, keys={f"public.{n}": k for n, k in keys.items()}, parallelism=2
    )
    staging = Staging(scratch_path(spark, "staging"), "shop")
    store, ledgers = RawStore(scratch_path(spark, "raw")), scratch_path(spark, "ledger")
    for _ in range(2):
        replicate(spark, tables, staging, store, options, ledgers)
    return store.read(spark).groupBy("raw_table").agg(
        F.count("*").alias("row_count"), F.countDistinct("_object_key").alias("chunks")
    )


# The queries over stored tables, ledgers and layouts register themselves here.
from tablesync.plans import stored_queries  # noqa: E402, F401
