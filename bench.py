"""Times the headline jobs and prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the local cores. Each query runs
once untimed on the smallest tables, then once timed; results are written to Spark's ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
WARM_DIR = os.path.join(os.path.dirname(SF_DIR.rstrip("/")), "sf0.001")


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("tablesync-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-tablesync-", dir="/tmp"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def stages(spark: SparkSession, sf: str) -> dict[str, float]:
    """Capture, load and incremental runs of the largest table, timed one by one."""
    from tablesync.model import INCREMENTAL, LEDGER
    from tablesync.plans.jobs import Capture, load_staging, snapshot_to_staging
    from tablesync.plans.queries import LINEITEM, table
    from tablesync.session import scratch_path
    from tablesync.sources.raw_store import RawStore
    from tablesync.sources.staged import Staging

    lineitem = table(spark, sf, "lineitem")
    empty = spark.createDataFrame([], LEDGER)
    out: dict[str, float] = {}

    def timed(name, fn):
        start = time.time()
        result = fn()
        out[name] = round(time.time() - start, 3)
        return result

    def staging(name):
        return Staging(scratch_path(spark, "bench"), name)

    by_key = Capture(chunk_size=50_000, keys={LINEITEM: ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]})
    area, store = staging("keyed"), RawStore(scratch_path(spark, "raw"))
    timed("capture_stage_lineitem_ordered",
          lambda: snapshot_to_staging(spark, {LINEITEM: lineitem}, area, by_key, empty))
    timed("load_lineitem", lambda: load_staging(spark, area, store).count())
    timed("reload_nothing_new", lambda: load_staging(spark, area, store).count())
    timed("capture_stage_lineitem_file_order", lambda: snapshot_to_staging(
        spark, {LINEITEM: f"{sf}/lineitem.parquet"}, staging("files"), Capture(chunk_size=50_000), empty))
    cursor = Capture(INCREMENTAL, 50_000, cursor="l_shipdate")
    delta = staging("delta")
    early = lineitem.filter("l_shipdate <= timestamp_ntz '2000-01-01'")
    first = snapshot_to_staging(spark, {LINEITEM: early}, delta, cursor, empty)
    timed("capture_stage_delta",
          lambda: snapshot_to_staging(spark, {LINEITEM: lineitem}, delta, cursor, first.ledger))
    return out


def main() -> None:
    from tablesync.plans.queries import QUERIES

    spark = session()
    names = [
        "snapshot_round_trip", "snapshot_chunks", "incremental_delta", "incremental_bounded",
        "text_round_trip", "table_progress", "checkpoint_fold", "load_report", "verify_key",
        "write_upsert", "write_merge", "keyed_table_merge", "latest_by_key", "reconcile_rows",
        "cdc_apply", "stream_cdc", "run_history", "run_status", "spec_versions", "replicate_tables",
    ]
    seconds: dict[str, float] = {}
    for name in names:
        QUERIES[name](spark, WARM_DIR).write.format("noop").mode("overwrite").save()
    stages(spark, WARM_DIR)
    for name in names:
        start = time.time()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    seconds.update(stages(spark, SF_DIR))
    print(json.dumps({
        "metric": "headline jobs, total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
