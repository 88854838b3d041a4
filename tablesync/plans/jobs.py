"""Whole jobs: capture to staging, staging to raw tables, and both with the ledger."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tablesync.functions.names import normalize_tables
from tablesync.model import FULL, INCREMENTAL, MANIFEST, MODES, NONE, PROGRESS
from tablesync.functions.codec import record_column
from tablesync.operators.checkpoint import apply_progress, fold_checkpoint, pending_tables, progress_columns
from tablesync.operators.chunking import (
    INDEX, ROW, SEQUENCE, assign_sequence, check_chunk_size, chunk_of, first_keys, key_struct, number_files,
    number_rows, pack,
)
from tablesync.operators.schema import schema_fingerprint
from tablesync.operators.sizing import line_bytes, width_ranges, width_sketch
from tablesync.plans.run_log import RunLog
from tablesync.session import local_frame, new_id
from tablesync.sources.capture import (
    after_key, capture_capped, capture_incremental, position_from_text,
)
from tablesync.sources.ledger import LedgerConflict, load_version, save_ledger, update_ledger
from tablesync.sources.raw_store import RawStore
from tablesync.sources.staged import (
    ORDER, Staging, adopt_foreign_chunks, check_manifest_bucket, chunk_manifest, commit_manifest,
    digest_columns, read_chunks, read_foreign_chunks, read_manifest, write_chunks, write_digested,
)

# Rows per file when a whole table is staged as one chunk.
UNCHUNKED_FILE_ROWS = 100_000


@dataclass(frozen=True)
class Capture:
    """How a pipeline reads its tables. ``keys`` holds each table's unique key columns.

    Without a chunk size files have at most ``batch_size`` rows, and with ``file_bytes`` at most that many
    bytes of text (before compression) too, but for a row that alone is wider.
    """

    mode: str = FULL
    chunk_size: int | None = None
    max_rows: int | None = None
    cursor: str | None = None
    overlap: object = None
    keys: dict[str, list[str]] = field(default_factory=dict)
    json_columns: tuple[str, ...] = ()
    parallelism: int = 1
    batch_size: int = UNCHUNKED_FILE_ROWS
    file_bytes: int | None = None

    def check(self, tables) -> None:
        if not tables:
            raise ValueError("at least one table must be captured")
        if self.mode not in MODES:
            raise ValueError(f"unknown snapshot mode {self.mode!r}")
        if self.chunk_size is not None:
            check_chunk_size(self.chunk_size)
        if self.mode == INCREMENTAL and not (self.cursor or "").strip():
            raise ValueError("incremental capture needs a cursor column")
        if self.batch_size <= 0 or self.parallelism <= 0:
            raise ValueError("batch size and parallelism must be greater than zero")
        if self.file_bytes is not None and (self.file_bytes <= 0 or self.chunk_size is not None):
            raise ValueError("a bound on the bytes of a file must be positive, and chunks have none: their rows are fixed")


@dataclass(frozen=True)
class Staged:
    """Result of one capture: its manifest rows, progress, and the ledger to save after the load."""

    manifest: DataFrame
    progress: DataFrame
    ledger: DataFrame
    run: str


def run_tables(spark: SparkSession, work, names, parallelism: int) -> list:
    """Run ``work`` per table, a bounded number of tables at once, each in its scheduler pool."""

    def one(name):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"table-{name}")
        try:
            return work(name)
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    if parallelism == 1 or len(names) <= 1:
        return [work(n) for n in names]
    with ThreadPoolExecutor(max_workers=min(parallelism, len(names))) as pool:
        return list(pool.map(inheritable_thread_target(spark)(one), names))


def _capture_table(df: DataFrame, capture: Capture, start, key):
    """The rows this run takes, their order, and whether a cap cut the table."""
    if capture.mode == INCREMENTAL:
        last = start["last_cursor_value"]
        if last is not None and start["cursor_type"] not in (
            None, df.schema[capture.cursor].dataType.simpleString()
        ):
            raise TypeError(
                f"cursor {capture.cursor} changed its type from {start['cursor_type']}"
            )
        rows = capture_incremental(df, capture.cursor, last, capture.overlap)
        order = [F.col(capture.cursor).isNull(), F.col(capture.cursor), *[F.col(k) for k in key]]  # null cursors last
        cap_by = [capture.cursor]
    else:
        position = position_from_text(start["last_key"])
        rows = df if position is None else after_key(df, position)
        order, cap_by = list(key), list(key)
    if capture.max_rows is None:
        return rows, order, False
    if not cap_by:
        raise ValueError("a capped full capture needs the table's key, to resume above it")
    counted = rows
    if capture.mode == INCREMENTAL and capture.overlap is not None:
        counted = capture_incremental(df, capture.cursor, last)
    rows, cut = capture_capped(rows, cap_by, capture.max_rows, counted)
    return rows, order, cut


def _stage_whole(rows, name, sequence, staging, attempt, capture, cursor, key) -> dict:
    """Stage rows as one chunk, straight from the scan; what they amount to is observed on the way."""
    seen = Observation(f"rows-{attempt}")
    packed = rows.select(pack(rows))
    record = record_column(packed, None, capture.json_columns, ROW)
    facts = [*progress_columns(packed, cursor, key), *digest_columns(record)]
    named = {"stream_name": F.lit(name), "sequence": F.lit(sequence).cast("bigint")}
    if capture.file_bytes is None:
        write_chunks(
            packed.observe(seen, *facts).withColumns(named), staging, None, attempt,
            rows_per_file=capture.batch_size, json_columns=capture.json_columns,
        )
        return seen.get
    width = line_bytes(record)
    sketch = width_sketch(packed.observe(seen, *facts), width).collect()  # a row per power of two
    if not sketch:  # an empty plan is not run, and observes nothing
        return {"rows_emitted": 0, "max_cursor_value": None, "last_key": None}
    written = []
    for part in width_ranges(sketch, capture.file_bytes, capture.batch_size):
        again = Observation(f"rows-{attempt}-{len(written)}")
        written.append(again)
        write_chunks(
            packed.filter(part.holds(width)).observe(again, *digest_columns(record)).withColumns(named), staging, None,
            attempt, rows_per_file=part.rows_per_file, json_columns=capture.json_columns, part=len(written),
        )
    for column in ("digest_rows", "digest_low", "digest_high"):
        if sum(int(w.get[column]) for w in written) != int(seen.get[column]):
            raise RuntimeError(f"table {name} changed while it was captured: its rows were measured and then written")
    return seen.get


def _stage_chunks(rows, order, unique, source, name, first, staging, attempt, capture, cursor, key) -> dict:
    """Stage rows in chunks, by one shuffle of the rows; what they amount to is observed on the way.

    Ordered rows find their chunk by the chunks' first keys, for which only keys are sorted. A
    folder in no order is numbered by its files. Where copies of one row lie on a boundary, and where rows
    have no order and are no folder, the rows are numbered in the scratch folder.
    """
    size, scratch = capture.chunk_size, None
    starts = first_keys(rows, order, size, unique) if order else None
    if starts is not None:
        keys, schema = starts
        count = len(keys)
        ordered = rows.select(pack(rows), key_struct(rows, order, unique).alias(ORDER))
        chunked = ordered.withColumn(SEQUENCE, chunk_of(F.col(ORDER), keys, schema) + F.lit(first)) if keys else None
    else:
        scratch = number_files(rows.sparkSession, source, packed=True) if source else number_rows(rows, order, unique, packed=True)
        count = -(-scratch.total // size)
        chunked = assign_sequence(scratch.df, size, first).withColumnRenamed(INDEX, ORDER)
    try:
        if not count:
            return {"next_sequence": first, "rows_emitted": 0, "max_cursor_value": None, "last_key": None}
        seen = Observation(f"rows-{attempt}")
        facts = [(F.max(SEQUENCE) + 1).alias("next_sequence"), *progress_columns(chunked, cursor, key)]
        write_digested(chunked, staging, name, attempt, count, facts, seen, capture.json_columns, size)
        return seen.get
    finally:
        if scratch is not None:
            scratch.release()


def snapshot_to_staging(
    spark: SparkSession, tables: dict[str, DataFrame | str], staging: Staging, capture: Capture,
    ledger: DataFrame, resume: bool = True, run: str | None = None,
) -> Staged:
    """Capture what the ledger leaves to do and stage it as one committed run.

    A table is a DataFrame or the path of a parquet folder. Without a chunk size rows are written
    as the scan yields them. In chunks, a whole folder without a declared key is numbered by file
    position; other captures sort their keys to find where chunks begin. Rows are shuffled once, and what
    was staged is not read again.

    Nothing is written to the ledger: the caller saves ``Staged.ledger`` once the chunks are
    loaded, so that a failed load is captured again.
    """
    names = normalize_tables(tables)
    capture.check(names)
    given = {normalize_tables([n])[0]: df for n, df in tables.items()}
    frames = {n: spark.read.parquet(t) if isinstance(t, str) else t for n, t in given.items()}
    keys = {normalize_tables([n])[0]: k for n, k in capture.keys.items()}
    requested = local_frame(spark, [(n,) for n in names], "table_name string")
    # One row per table.
    starts = {
        r["table_name"]: r
        for r in pending_tables(requested, ledger, staging.pipeline, capture.mode, resume).collect()
    }
    run = run or new_id()
    attempts = {n: f"{run}-{i:05d}" for i, n in enumerate(names)}
    base = ledger if resume else ledger.limit(0)

    def stage(name):
        start, key = starts[name], keys.get(name, [])
        df = frames[name]
        rows, order, cut = _capture_table(df, capture, start, key)
        first = start["start_sequence"]
        cursor = capture.cursor if capture.mode == INCREMENTAL else None
        last_by = key if capture.mode == FULL else ()
        kind = df.schema[cursor].dataType.simpleString() if cursor else None
        progress = lambda seen, sequence: (
            name, sequence, not cut, seen["rows_emitted"], seen["max_cursor_value"], kind, seen["last_key"],
        )
        if capture.chunk_size is None:
            seen = _stage_whole(rows, name, first, staging, attempts[name], capture, cursor, last_by)
            if not seen["rows_emitted"]:
                return progress(seen, first + 1), (attempts[name], name, first), None
            digest = "-".join(str(seen[f"digest_{part}"]) for part in ("rows", "low", "high"))
            return progress(seen, first + 1), None, {attempts[name]: digest}
        source = given[name] if isinstance(given[name], str) and rows is df and not order else None
        seen = _stage_chunks(
            rows, order, bool(key), source, name, first, staging, attempts[name], capture, cursor, last_by
        )
        return progress(seen, seen["next_sequence"]), None, {attempts[name]: None} if seen["rows_emitted"] else None

    done = run_tables(spark, stage, [n for n in names if n in starts], capture.parallelism)
    progress = local_frame(spark, [p for p, _, _ in done], PROGRESS)
    if not done:
        return Staged(local_frame(spark, [], MANIFEST), progress, base, run)
    empty = [e for _, e, _ in done if e]
    digests = {a: d for *_, known in done if known for a, d in known.items()}
    prints = {n: schema_fingerprint(frames[n].schema) for n in starts}
    written = [attempts[p[0]] for p, *_ in done if p[3]]
    if written or empty:
        found = chunk_manifest(spark, staging, written, prints, empty, digests)
        manifest = commit_manifest(found, staging, run)
    else:
        manifest = local_frame(spark, [], MANIFEST)
    new_ledger = apply_progress(fold_checkpoint(base, manifest), progress, staging.pipeline)
    return Staged(manifest, progress, new_ledger, run)


def load_staging(
    spark: SparkSession, staging: Staging, target: RawStore, replace: bool = False
) -> DataFrame:
    """Load every staged chunk of the pipeline that is not applied yet, and report on all.

    A pipeline without staged chunks is an error.
    """
    reports = []
    own = read_manifest(spark, staging, all_attempts=False)
    if check_manifest_bucket(own, staging.bucket):
        reports.append(target.load(own, lambda c: read_chunks(spark, staging, c), replace))
    foreign = adopt_foreign_chunks(spark, staging)
    if foreign is not None and foreign.take(1):
        reports.append(
            target.load(foreign, lambda c: read_foreign_chunks(spark, staging, c), replace)
        )
    if not reports:
        raise LookupError(
            f"pipeline {staging.pipeline} has staged nothing below {staging.base}"
        )
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r)
    return out


def _save_progress(spark, staged: Staged, version: int, root: str, pipeline: str, resume: bool) -> None:
    """Save a run's ledger; if another run of the pipeline saved its own meanwhile, fold into that one."""
    try:
        save_ledger(staged.ledger, root, pipeline, version)
    except LedgerConflict:
        if not resume:
            raise  # a run that starts afresh must not mix with one that goes on
        update_ledger(
            spark, root, pipeline, lambda now: apply_progress(fold_checkpoint(now, staged.manifest), staged.progress, pipeline)
        )


def replicate(
    spark: SparkSession, tables: dict[str, DataFrame | str], staging: Staging, target: RawStore,
    capture: Capture, ledger_root: str, resume: bool = True, replace: bool = False,
    log: RunLog | None = None,
) -> DataFrame:
    """Capture, stage, load, then save the ledger; returns the load report.

    The ledger moves last, so a failure anywhere repeats the capture and loses nothing. A run
    with nothing new succeeds with an empty report. With a ``log`` the run's status, its tables'
    states and its chunks are recorded as it goes, its failure included.
    """
    run = new_id()

    def say(status, phase=None, step=None, stats=None):
        if log is not None:
            log.status(spark, run, staging.pipeline, status, phase, step, stats)

    say("running", "snapshot", (0, 2))
    try:
        ledger, version = load_version(spark, ledger_root, staging.pipeline)
        staged = snapshot_to_staging(spark, tables, staging, capture, ledger, resume, run)
        if log is not None:
            log.artifacts(run, staged.manifest)
            log.tables(run, staged.manifest, staged.ledger, "staged")
        say("running", "load", (1, 2))
        report = target.load(staged.manifest, lambda c: read_chunks(spark, staging, c), replace)
        if log is not None:
            log.tables(run, staged.manifest, staged.ledger, "applied")
        if capture.mode != NONE:
            _save_progress(spark, staged, version, ledger_root, staging.pipeline, resume)
    except Exception as e:
        say("failed", stats={"error": f"{type(e).__name__}: {e}"[:2000]})
        raise
    say("succeeded", "done", (2, 2))
    return report
