"""Registered queries over what is stored: odd column names, many files, deltas, compaction, ledgers, foreign chunks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.functions.codec import encode_rows, project_typed
from tablesync.functions.names import chunk_key
from tablesync.model import FULL, INCREMENTAL, LEDGER
from tablesync.operators import checkpoint, reconcile, sizing
from tablesync.operators.chunking import SEQUENCE, capture_chunked, chunk_row_counts
from tablesync.plans.jobs import Capture, load_staging, replicate, snapshot_to_staging
from tablesync.plans.queries import (
    CHUNK, EVENTS, LINE_ORDER, LINEITEM, ORACLE, ORDERS, _changes, _damaged_orders, _order_target, _order_updates,
    _UPDATE_ORDER, register, table,
)
from tablesync.session import local_frame, scratch_path
from tablesync.sources import capture
from tablesync.sources.commits import entries, rename
from tablesync.sources.delta_table import DeltaTable
from tablesync.sources.evolving_table import EvolvingTable
from tablesync.sources.ledger import LedgerConflict, load_version, save_ledger, update_ledger
from tablesync.sources.raw_store import RawStore
from tablesync.sources.staged import Staging, file_texts, read_staged, remove_loaded
from tablesync.streaming.changes import cdc_stream, delta_cdc_table
from tablesync.streaming.loader import stream_foreign_load

# Orders under names that the library uses for columns of its own.
CLASHING = {
    "o_orderkey": "sequence", "o_custkey": "stream_name", "o_orderstatus": "partition_key", "o_totalprice": "_tie",
    "o_orderdate": "_row_index", "o_orderpriority": "_file",
}
COPIES = ("_row_id", "_row", "_pos", "_scan_pos", "value", "attempt", "_partition", "_offset", "object_key", "_data", "_hash")


def _clashing(orders):
    named = [F.col(c).alias(n) for c, n in CLASHING.items()]
    return orders.select(*named, *[F.col("o_orderkey").alias(c) for c in COPIES])


@register("""
SELECT mode, o.*, CAST(11 AS BIGINT) AS right_copies
FROM orders o, (VALUES ('chunked'), ('whole'), ('folder'), ('unkeyed'), ('incremental')) m(mode)""")
def clashing_columns_round_trip(spark, sf):
    """Columns named like the library's own, through every kind of capture, the load and back."""
    orders = table(spark, sf, "orders")
    rows = _clashing(orders)
    folder = scratch_path(spark, "clashing")
    rows.write.parquet(folder)
    keys = {ORDERS: ["sequence"]}
    modes = {
        "chunked": (rows, Capture(chunk_size=CHUNK, keys=keys)), "whole": (rows, Capture(batch_size=CHUNK, keys=keys)),
        "folder": (folder, Capture(chunk_size=CHUNK)), "unkeyed": (rows, Capture(chunk_size=CHUNK)),
        "incremental": (rows, Capture(INCREMENTAL, CHUNK, cursor="_row_index", keys=keys)),
    }
    out = None
    for mode, (source, options) in modes.items():
        staging, store = Staging(scratch_path(spark, "staging"), "shop"), RawStore(scratch_path(spark, "raw"))
        snapshot_to_staging(spark, {ORDERS: source}, staging, options, local_frame(spark, [], LEDGER))
        load_staging(spark, staging, store)
        back = project_typed(store.read(spark, ORDERS), rows.schema)
        copies = sum((F.col(c) == F.col("sequence")).cast("bigint") for c in COPIES)
        back = back.select(F.lit(mode).alias("mode"), *[F.col(n).alias(c) for c, n in CLASHING.items()], copies.alias("right_copies"))
        out = back if out is None else out.unionByName(back)
    return out


@register("SELECT * FROM lineitem")
def snapshot_many_files(spark, sf):
    """A folder of many small files, numbered from their footers: no row is sorted, shuffled or copied for it."""
    lineitem = table(spark, sf, "lineitem")
    folder = scratch_path(spark, "many")
    lineitem.repartition(120).write.parquet(folder)
    staging = Staging(scratch_path(spark, "staging"), "shop")
    snapshot_to_staging(spark, {LINEITEM: folder}, staging, Capture(chunk_size=CHUNK), local_frame(spark, [], LEDGER))
    return project_typed(read_staged(spark, staging), lineitem.schema, "value")


@register(f"""
SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (ORDER BY {', '.join(LINE_ORDER)}) AS n FROM lineitem)
WHERE n <= (SELECT count(*) * 2 // 3 FROM lineitem)""")
def selected_key_cap(spark, sf):
    """The first two thirds of a table in key order, by selecting the last row's key instead of sorting."""
    lineitem = table(spark, sf, "lineitem")
    return capture.capture_bounded(lineitem, LINE_ORDER, lineitem.count() * 2 // 3, top_k=500)


# A bound on the bytes of a staged file that some of the widened documents alone exceed.
FILE_BYTES = 64 << 10
# A task leaves at most one file that is not full per width range, which are at most one per power of two.
MOST_RANGES = 32


@register("""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN repeat(text, 60) ELSE text END AS text FROM documents)
SELECT doc_id, length(text) AS n, md5(text) AS digest, CAST(0 AS BIGINT) AS oversized_files, true AS few_files FROM d""")
def sized_files(spark, sf):
    """Documents, every fiftieth sixty times as wide, in files of bounded bytes; only single rows exceed the bound."""
    wider = F.when(F.col("doc_id") % 50 == 0, F.repeat("text", 60)).otherwise(F.col("text"))
    docs = table(spark, sf, "documents").select("doc_id", wider.alias("text"))
    staging = Staging(scratch_path(spark, "staging"), "shop")
    options = Capture(file_bytes=FILE_BYTES)
    staged = snapshot_to_staging(spark, {"public.documents": docs}, staging, options, local_frame(spark, [], LEDGER))
    seen = file_texts(spark, staging).agg(
        F.count_if((F.col("bytes") > FILE_BYTES) & (F.col("n") > 1)).alias("oversized"), F.count("*").alias("files"), F.sum("bytes").alias("bytes"),
    ).first()
    few = seen["files"] <= sizing.MOST_FILES * (seen["bytes"] // FILE_BYTES + 1) + MOST_RANGES * docs.rdd.getNumPartitions()
    back = project_typed(read_staged(spark, staging), docs.schema, "value")
    return back.select(
        "doc_id", F.length("text").cast("long").alias("n"), F.md5("text").alias("digest"),
        F.lit(seen["oversized"]).alias("oversized_files"), F.lit(few and staged.manifest.count() == 1).alias("few_files"),
    )


# ------------------------------------------------------------ stored tables


def _merged_deltas(spark, sf):
    target, updates = _order_target(spark, sf), _order_updates(spark, sf)
    stored = DeltaTable(scratch_path(spark, "deltas"), ("o_orderkey",), target.schema, 8)
    stored.replace(target)
    for part in range(5):
        stored.merge(updates.filter(F.pmod("o_orderkey", F.lit(5)) == part), _UPDATE_ORDER)
    return stored


@register(ORACLE["write_merge"])
def keyed_table_deltas(spark, sf):
    """The merge in five batches, each written as small runs beside its buckets and folded on read."""
    return _merged_deltas(spark, sf).read(spark)


@register(ORACLE["write_merge"])
def keyed_table_compacted(spark, sf):
    """The same after all runs were merged and the old ones removed."""
    stored = _merged_deltas(spark, sf)
    stored.compact(spark, everything=True)
    stored.vacuum(spark, grace_ms=-1000)
    return stored.read(spark)


@register(ORACLE["stream_cdc"])
def stream_cdc_deltas(spark, sf):
    """A change stream into a table merged on read: a batch writes small runs, whatever the size of a bucket."""
    customer, events = table(spark, sf, "customer"), table(spark, sf, "events")
    stored = delta_cdc_table(scratch_path(spark, "cdc"), "c_custkey", customer.schema, 8)
    changes = _changes(spark.readStream.schema(events.schema).parquet(f"{sf}/events*.parquet"))
    progress = scratch_path(spark, "stream")
    cdc_stream(changes, stored, progress, FULL, customer, 100).awaitTermination()
    cdc_stream(changes, stored, progress).awaitTermination()
    return stored.read(spark).drop("_lsn", "_deleted")


@register("SELECT * FROM orders")
def compacted_raw(spark, sf):
    """Three loads rewritten as one; staged chunks, old loads and a dead load removed afterwards."""
    orders = table(spark, sf, "orders")
    staging, store = Staging(scratch_path(spark, "staging"), "shop"), RawStore(scratch_path(spark, "raw"))
    options = Capture(INCREMENTAL, CHUNK, cursor="o_orderdate", keys={ORDERS: ["o_orderkey"]})
    ledgers = scratch_path(spark, "ledger")
    for year in ("1995", "1997", "2100"):
        replicate(spark, {ORDERS: orders.filter(f"o_orderdate < timestamp_ntz '{year}-01-01'")}, staging, store, options, ledgers)
    store.compact(spark)
    remove_loaded(spark, staging, store.applied(spark), grace_ms=-1000)
    store.vacuum(spark, grace_ms=-1000)
    return project_typed(store.read(spark, ORDERS), orders.schema)


@register(ORACLE["reconcile_rows"])
def reconcile_tree(spark, sf):
    """Differing rows found through digests of key ranges; equal ranges are never compared by row."""
    return reconcile.reconcile_tree(table(spark, sf, "orders"), _damaged_orders(spark, sf), "o_orderkey")


# ------------------------------------------------------------ ledger, foreign layout


@register(ORACLE["checkpoint_fold"])
def ledger_concurrent(spark, sf):
    """Two writers that read one ledger: the second is refused and folds into what the first saved."""
    root = scratch_path(spark, "ledger")

    def staged(name, stream):
        chunks = chunk_row_counts(capture_chunked(table(spark, sf, name), [], CHUNK)).withColumn("stream_name", F.lit(stream))
        return chunks.withColumns(
            {"pipeline_name": F.lit("shop"), "object_key": chunk_key("shop", F.col("stream_name"), F.col(SEQUENCE))}
        )

    ledger, version = load_version(spark, root, "shop")
    save_ledger(checkpoint.fold_checkpoint(ledger, staged("orders", ORDERS)), root, "shop", version)
    late = staged("lineitem", LINEITEM)
    try:
        save_ledger(checkpoint.fold_checkpoint(ledger, late), root, "shop", version)
    except LedgerConflict:
        update_ledger(spark, root, "shop", lambda now: checkpoint.fold_checkpoint(now, late))
    return load_version(spark, root, "shop")[0].select(
        "pipeline_name", "table_name", "next_sequence", "rows_staged", "last_chunk_key", "completed"
    )


def _foreign_chunks(spark, events, staging):
    """Chunk files of ``events`` as another tool lays them out, put in place when their number is asked for."""
    chunked = capture_chunked(events, ["event_id"], CHUNK, unique=True)
    lines = encode_rows(chunked, events.columns, keep=[SEQUENCE])
    written = scratch_path(spark, "foreign")
    few = lines.repartition(SEQUENCE).withColumnRenamed("record", "value")
    few.write.partitionBy(SEQUENCE).option("compression", "gzip").text(written)
    target = f"{staging.chunks}/streams/{EVENTS}/partitions/default/chunks"

    def place(wanted):
        for folder, _ in entries(spark, written):
            number = int(folder.split("=")[1]) if folder.startswith(f"{SEQUENCE}=") else -1
            if number >= 0 and wanted(number):
                part, = [n for n, _ in entries(spark, f"{written}/{folder}") if n.endswith(".gz")]
                rename(spark, f"{written}/{folder}/{part}", f"{target}/{number:020d}.jsonl.gz")

    return place


@register("SELECT 'public.events' AS stream, e.* EXCLUDE (props) FROM events e")
def foreign_chunks_loaded(spark, sf):
    """Chunks laid out as another tool stages them, loaded once; the second load reads no text."""
    events = table(spark, sf, "events").drop("props")
    staging, store = Staging(scratch_path(spark, "staging"), "shop"), RawStore(scratch_path(spark, "raw"))
    _foreign_chunks(spark, events, staging)(lambda number: True)
    load_staging(spark, staging, store)
    load_staging(spark, staging, store)
    rows = project_typed(store.read(spark, EVENTS), events.schema)
    return rows.select(F.lit(EVENTS).alias("stream"), *events.columns)


@register(ORACLE["foreign_chunks_loaded"])
def stream_foreign_chunks(spark, sf):
    """The same chunks loaded by a stream that stops, and goes on when the rest has arrived."""
    events = table(spark, sf, "events").drop("props")
    staging, store = Staging(scratch_path(spark, "staging"), "shop"), RawStore(scratch_path(spark, "raw"))
    checkpoint_path, place = scratch_path(spark, "stream"), _foreign_chunks(spark, events, staging)
    for parity in (0, 1):
        place(lambda number: number % 2 == parity)
        query = stream_foreign_load(spark, staging, store, checkpoint_path)
        query.awaitTermination()
    rows = project_typed(store.read(spark, EVENTS), events.schema)
    return rows.select(F.lit(EVENTS).alias("stream"), *events.columns)


@register("""
SELECT CASE WHEN o_orderkey % 3 = 2 THEN o_orderpriority END AS o_totalprice, o_orderkey, o_totalprice AS price,
       CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS o_orderstatus, o_custkey FROM orders""")
def evolved_store_read(spark, sf):
    """Rows appended under three versions of a schema, read as one table; no file is rewritten."""
    orders = table(spark, sf, "orders")
    part = lambda i: orders.filter(F.pmod("o_orderkey", F.lit(3)) == i)
    field = lambda name, dtype: T.StructField(name, dtype)
    stored = EvolvingTable(scratch_path(spark, "evolving"))
    stored.change(spark, add=[
        field("o_orderkey", T.LongType()), field("o_totalprice", T.DoubleType()), field("o_custkey", T.IntegerType()),
        field("o_orderdate", T.TimestampNTZType()),
    ])
    stored.append(part(0).select("o_orderkey", "o_totalprice", "o_custkey", "o_orderdate"))
    stored.change(spark, rename={"o_totalprice": "price"}, add=[field("o_orderstatus", T.StringType())])
    stored.append(part(1).select("o_orderkey", F.col("o_totalprice").alias("price"), "o_custkey", "o_orderstatus"))
    # the name of a renamed column is used again, another column is dropped, a third one widened
    stored.change(spark, drop=["o_orderdate"], widen={"o_custkey": T.LongType()}, add=[field("o_totalprice", T.StringType())])
    stored.append(part(2).select(
        "o_orderkey", F.col("o_totalprice").alias("price"), "o_custkey", "o_orderstatus", F.col("o_orderpriority").alias("o_totalprice")
    ))
    return stored.read(spark)
