"""A keyed table that is merged on read: changes are small sorted runs beside their bucket.

Layout::

    <path>/data/bucket=<b>/run=<ordinal>-<id>/part-*.parquet   rows of a bucket, sorted by key
    <path>/log/<20 digits>                                     the runs of each bucket, as of a version

A change writes one run per bucket it touches, however large the bucket, and one log file, which
makes it visible; two writers cannot both commit a version. A run holds at most one row per key, with
a flag for deleted keys. Readers take, per key, the row of the newest run or, with an order column, the
row of the greatest order. The oldest run of a bucket, which holds most rows, is not shuffled for
that while the newer ones are few.

Compaction is tiered by size: when ``tier`` runs of a bucket are of like size, they and the newer ones
become one, so a row is rewritten a number of times that grows with the logarithm of its bucket. Old versions
stay readable until ``vacuum`` removes what no kept version names.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.operators.chunking import fresh_names
from tablesync.operators.writes import latest_by_key
from tablesync.session import broadcast_if_small, local_frame, new_id, read_or_none
from tablesync.sources.commits import CommitConflict, commit, committed, delete, entries, read_commit

DAY_MS = 86_400_000


@dataclass(frozen=True)
class Run:
    name: str  # ordinal and id; sorts by age
    rows: int


Runs = dict[int, list[Run]]  # per bucket, oldest first


@dataclass(frozen=True)
class DeltaTable:
    path: str
    key: tuple[str, ...]
    schema: T.StructType
    buckets: int = 16
    order: str | None = None  # the greater one wins, whatever the order of arrival
    deleted: str | None = field(default=None)  # flag column of deleted keys (change logs)
    tier: int = 4  # runs of like size that are merged

    # -------------------------------------------------------- the log

    @property
    def _log(self) -> str:
        return f"{self.path}/log"

    def version(self, spark: SparkSession) -> int:
        numbers = committed(spark, self._log)
        return numbers[-1] if numbers else 0

    def runs(self, spark: SparkSession, version: int | None = None) -> Runs:
        """Runs per bucket as of a version: a few per bucket, whatever the number of rows."""
        version = self.version(spark) if version is None else version
        if version == 0:
            return {}
        state = json.loads(read_commit(spark, self._log, version))
        if state["buckets"] != self.buckets:
            raise ValueError(f"{self.path} has {state['buckets']} buckets, not {self.buckets}")
        return {int(b): [Run(*r) for r in runs] for b, runs in state["runs"].items()}

    def _commit(self, spark: SparkSession, version: int, runs: Runs) -> None:
        state = {"buckets": self.buckets, "runs": {b: [[r.name, r.rows] for r in rs] for b, rs in sorted(runs.items()) if rs}}
        commit(spark, self._log, version, json.dumps(state))

    # -------------------------------------------------------- reading

    def _names(self) -> tuple[str, str, str]:
        """Names of the bucket, run and gone columns, unlike any of the table."""
        empty = self._spark().createDataFrame([], self.schema)
        return tuple(fresh_names(empty, "bucket", "run", "gone"))

    @staticmethod
    def _spark() -> SparkSession:
        return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.key]), F.lit(self.buckets)).cast("int")

    def _stored(self, bucket: str, run: str, gone: str) -> T.StructType:
        return T.StructType([
            *self.schema.fields, T.StructField(gone, T.BooleanType()), T.StructField(bucket, T.IntegerType()),
            T.StructField(run, T.StringType()),
        ])

    def _scan(self, spark: SparkSession, runs: Runs) -> DataFrame:
        bucket, run, gone = self._names()
        paths = [f"{self.path}/data/{bucket}={b}/{run}={r.name}" for b, rs in sorted(runs.items()) for r in rs]
        if not paths:
            return local_frame(spark, [], self._stored(bucket, run, gone))
        return spark.read.schema(self._stored(bucket, run, gone)).option("basePath", f"{self.path}/data").parquet(*paths)

    def _folded(self, spark: SparkSession, runs: Runs) -> DataFrame:
        """One row per key, deleted ones included, with the run it comes from.

        The oldest runs pass through where no newer run has their key; only the newer runs, and of
        the oldest ones the rows they beat, meet by key.
        """
        _, run, gone = self._names()
        base = self._scan(spark, {b: rs[:1] for b, rs in runs.items()})
        newer = {b: rs[1:] for b, rs in runs.items() if len(rs) > 1}
        if not newer:
            return base
        by = [self.order, run] if self.order else [run]
        latest = latest_by_key(self._scan(spark, newer), list(self.key), by, tie_break=False)
        at, other, mark = fresh_names(base, "at", "other", "hit")
        keys = [F.col(f"`{k}`").alias(f"{other}{i}") for i, k in enumerate(self.key)]
        mine = F.col(f"`{self.order}`") if self.order else F.lit(0)
        few = broadcast_if_small(latest.select(*keys, mine.alias(at), F.lit(True).alias(mark)))
        same = F.lit(True)
        for i, k in enumerate(self.key):
            same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"{other}{i}"))
        met = base.join(few, same, "left")
        if self.order is None:
            return met.filter(F.col(mark).isNull()).select(*base.columns).unionByName(latest)
        # with an order, an older run may hold the greater one
        stays = F.coalesce(F.col(f"`{self.order}`") > F.col(at), F.lit(False))
        beaten = met.filter(F.col(mark) & stays).select(*[F.col(f"{other}{i}") for i in range(len(self.key))])
        kept = met.filter(F.col(mark).isNull() | stays).select(*base.columns)
        return kept.unionByName(latest.join(broadcast_if_small(beaten), same, "left_anti"))

    def read(self, spark: SparkSession, version: int | None = None, raw: bool = False) -> DataFrame:
        """Rows as of a version (the newest); deleted keys are hidden unless ``raw``."""
        *_, gone = self._names()
        rows = self._folded(spark, self.runs(spark, version)).filter(~F.col(gone)).select(*[F.col(f"`{c}`") for c in self.schema.names])
        return rows if raw or self.deleted is None else rows.filter(~F.col(f"`{self.deleted}`"))

    # -------------------------------------------------------- writing

    def _write(self, rows: DataFrame, ordinal: int) -> Runs:
        """One sorted run per bucket among the rows, of one ordinal; its row counts come from the footers."""
        spark = rows.sparkSession
        bucket, run, gone = self._names()
        name = f"{ordinal:012d}-{new_id()}"
        placed = rows.select(*[F.col(f"`{c}`") for c in self.schema.names], gone, self._bucket().alias(bucket), F.lit(name).alias(run))
        sorted_ = placed.repartition(bucket).sortWithinPartitions(bucket, *[F.col(f"`{k}`") for k in self.key])
        sorted_.write.partitionBy(bucket, run).mode("append").parquet(f"{self.path}/data")
        mine = read_or_none(
            spark, f"{self.path}/data/{bucket}=*/{run}={name}", self._stored(bucket, run, gone), basePath=f"{self.path}/data",
        )
        # one row per bucket
        counted = [] if mine is None else mine.groupBy(bucket).count().collect()
        return {r[0]: [Run(name, r[1])] for r in counted}

    def _change(self, rows: DataFrame, whole: bool = False) -> None:
        """Commit rows (one per key, with the gone flag) as runs; ``whole`` replaces all others.

        A writer that lost the race for a version takes the next one: its runs are then newer than
        those of the winner, as if it had begun after it.
        """
        spark = rows.sparkSession
        ordinal = self.version(spark) + 1
        written = self._write(rows, ordinal)
        if not written and not whole:
            return
        for _ in range(20):
            version = self.version(spark)
            old = {} if whole else self.runs(spark, version)
            if version + 1 > ordinal and any(int(r.name.split("-")[0]) >= ordinal for rs in old.values() for r in rs):
                ordinal = version + 1
                written = self._write(rows, ordinal)
            try:
                self._commit(spark, version + 1, {b: old.get(b, []) + written.get(b, []) for b in old.keys() | written.keys()})
            except CommitConflict:
                continue
            self.compact(spark)
            return
        raise CommitConflict(f"{self.path} is written by too many writers at once")

    def _alive(self, rows: DataFrame) -> DataFrame:
        *_, gone = self._names()
        return rows.select(*[F.col(f"`{c}`") for c in self.schema.names], F.lit(False).alias(gone))

    def replace(self, rows: DataFrame) -> None:
        """Swap the whole contents as one version; keys must be unique."""
        self._change(self._alive(rows), whole=True)

    def upsert(self, updates: DataFrame, order) -> None:
        self._change(self._alive(latest_by_key(updates, list(self.key), order)))

    def merge(self, updates: DataFrame, order, op: str = "op", delete: str = "D") -> None:
        """Upsert that also removes keys whose latest update is a delete."""
        *_, gone = self._names()
        newest = latest_by_key(updates, list(self.key), order)
        columns = [F.col(f"`{c}`") if c in newest.columns else F.lit(None).cast(self.schema[c].dataType).alias(c) for c in self.schema.names]
        self._change(newest.select(*columns, F.col(op).eqNullSafe(F.lit(delete)).alias(gone)))

    def keep_latest(self, rows: DataFrame) -> None:
        """Fold rows in by the table's own order column: a replayed or late change has no effect."""
        if self.order is None:
            raise ValueError("keep_latest needs a table with an order column")
        self._change(self._alive(latest_by_key(rows.select(*self.schema.names), list(self.key), self.order)))

    # -------------------------------------------------------- compaction and clean-up

    def _due(self, runs: list[Run]) -> int:
        """How many of the newest runs to merge: those from the oldest of ``tier`` runs of like size on."""
        size = lambda r: max(r.rows, 1).bit_length() // 2  # noqa: E731  sizes within a factor of four are alike
        for i, first in enumerate(runs):
            if sum(size(r) == size(first) for r in runs[i:]) >= self.tier:
                return len(runs) - i
        return 0

    def compact(self, spark: SparkSession, everything: bool = False) -> int:
        """Merge runs of like size, or all runs of each bucket; returns the number of buckets rewritten.

        A writer that commits in between wins: the merge is dropped, and a later one makes up for it.
        """
        version = self.version(spark)
        runs = self.runs(spark, version)
        due = {b: len(rs) if everything else self._due(rs) for b, rs in runs.items()}
        due = {b: n for b, n in due.items() if n > 1}
        if not due:
            return 0
        *_, gone = self._names()
        merged: Runs = {}
        # buckets merged down to their oldest run need no flags of deleted keys any more
        for to_base in (True, False):
            some = {b: runs[b][-n:] for b, n in due.items() if (n == len(runs[b])) == to_base}
            if some:
                rows = self._folded(spark, some)
                newest = max(int(rs[-1].name.split("-")[0]) for rs in some.values())
                merged |= self._write(rows.filter(~F.col(gone)) if to_base else rows, newest)
        after = {b: (rs[: -due[b]] + merged.get(b, [])) if b in due else rs for b, rs in runs.items()}
        try:
            self._commit(spark, version + 1, after)
        except CommitConflict:
            return 0
        return len(due)

    def vacuum(self, spark: SparkSession, keep_versions: int = 1, grace_ms: int = DAY_MS, now_ms: int | None = None) -> int:
        """Delete runs that none of the kept versions names and the older log files; returns how many runs.

        Nothing younger than ``grace_ms`` goes, so neither a run that is being written nor one that a
        running reader of a superseded version still needs. Log files go first: a version whose
        runs are incomplete is never listed.
        """
        numbers = committed(spark, self._log)
        if not numbers:
            return 0
        before = (int(time.time() * 1000) if now_ms is None else now_ms) - grace_ms
        log_times = dict(entries(spark, self._log))
        # a version is superseded when the next one appears
        old = [n for n, after in zip(numbers, numbers[1:]) if log_times[f"{after:020d}"] < before][: max(len(numbers) - keep_versions, 0)]
        live = {(b, r.name) for n in numbers if n not in old for b, rs in self.runs(spark, n).items() for r in rs}
        for n in old:
            delete(spark, f"{self._log}/{n:020d}")
        bucket, run, _ = self._names()
        removed = 0
        for folder, _ in entries(spark, f"{self.path}/data"):
            if not folder.startswith(f"{bucket}="):
                continue
            for name, written in entries(spark, f"{self.path}/data/{folder}"):
                if name.startswith(f"{run}=") and written < before:
                    if (int(folder.split("=")[1]), name.split("=", 1)[1]) not in live:
                        removed += delete(spark, f"{self.path}/data/{folder}/{name}")
        return removed
