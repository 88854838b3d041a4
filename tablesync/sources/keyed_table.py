"""A keyed table in versioned buckets, for updates without a table format that can merge.

Rows live in ``data/bucket=<b>/version=<v>`` by the hash of their key. A change rewrites only the
buckets it touches, under a new version, and then one small file that maps each bucket to its
version makes the change visible as a whole. A failed change leaves folders nobody reads. That file
holds the number of buckets, too: a table opened with another number is refused, since its keys
would be looked for in the wrong buckets, and ``rebucket`` rewrites it.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.operators.writes import latest_by_key, write_merge, write_upsert
from tablesync.session import local_frame, new_id, read_or_none

_MAP = "bucket int, data_version string, buckets int, version bigint"


@dataclass(frozen=True)
class KeyedTable:
    path: str
    key: tuple[str, ...]
    schema: T.StructType
    buckets: int = 16
    # Files per bucket and rewrite; raise it with the size of a bucket.
    files_per_bucket: int = 1
    # Name of an order column kept with the row, and of a flag for deleted keys (change logs).
    order: str | None = None
    deleted: str | None = field(default=None)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _slot(self) -> Column:
        spread = F.lit(self.buckets * self.files_per_bucket)
        return F.pmod(F.xxhash64(*self.key), spread)

    def _mapping(self, spark: SparkSession) -> tuple[dict[int, str], int]:
        """Bucket to data version, and the table version. At most one row per bucket."""
        rows = read_or_none(spark, f"{self.path}/versions", _MAP)
        if rows is None:
            return {}, 0
        newest = rows.agg(F.max("version")).first()[0]
        if newest is None:
            return {}, 0
        current = rows.filter(F.col("version") == newest).select("bucket", "data_version", "buckets").collect()
        stored = {r["buckets"] for r in current} - {None, self.buckets}
        if stored:
            raise ValueError(f"{self.path} has {stored.pop()} buckets, not {self.buckets}; rebucket() changes that")
        return {r[0]: r[1] for r in current if r[0] is not None}, newest

    def read(self, spark: SparkSession, buckets=None, raw: bool = False) -> DataFrame:
        """Current rows; deleted keys are hidden unless ``raw``."""
        mapping, _ = self._mapping(spark)
        paths = [
            f"{self.path}/data/bucket={b}/version={v}"
            for b, v in sorted(mapping.items()) if buckets is None or b in buckets
        ]
        rows = (
            spark.read.schema(self.schema).parquet(*paths) if paths
            else local_frame(spark, [], self.schema)
        )
        return rows if raw or self.deleted is None else rows.filter(~F.col(self.deleted))

    def _write(self, rows: DataFrame, touched, keep: dict[int, str], version: int) -> None:
        spark = rows.sparkSession
        data_version = new_id()
        placed = rows.select(*self.schema.names).withColumns(
            {"bucket": self._bucket(), "version": F.lit(data_version)}
        )
        placed.repartition(self._slot()).write.partitionBy("bucket", "version").mode("append").parquet(
            f"{self.path}/data"
        )
        layout = T.StructType([
            *self.schema.fields, T.StructField("bucket", T.IntegerType()),
            T.StructField("version", T.StringType()),
        ])
        base = f"{self.path}/data"
        mine = read_or_none(spark, f"{base}/bucket=*/version={data_version}", layout, basePath=base)
        written = [] if mine is None else [r[0] for r in mine.select("bucket").distinct().collect()]
        mapping = {b: v for b, v in keep.items() if touched is not None and b not in touched}
        mapping.update({b: data_version for b in written})
        self._publish(spark, mapping, version + 1)

    def _publish(self, spark: SparkSession, mapping: dict[int, str], version: int) -> None:
        """Write the bucket map of a version as one file, which makes the version current."""
        entries = [(b, v, self.buckets) for b, v in sorted(mapping.items())] or [(None, None, self.buckets)]
        rows = local_frame(spark, entries, "bucket int, data_version string, buckets int")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/versions/version={version}")

    def _touched(self, changes: DataFrame) -> set[int]:
        return {r[0] for r in changes.select(self._bucket().alias("b")).distinct().collect()}

    def replace(self, rows: DataFrame) -> None:
        """Swap the whole contents as one unit."""
        keep, version = self._mapping(rows.sparkSession)
        self._write(rows, None, keep, version)

    def rebucket(self, spark: SparkSession, buckets: int) -> KeyedTable:
        """The table rewritten into another number of buckets, as one unit."""
        _, version = self._mapping(spark)
        wider = replace(self, buckets=buckets)
        wider._write(self.read(spark, raw=True), None, {}, version)
        return wider

    def append(self, rows: DataFrame) -> None:
        self._rewrite(rows, lambda current: current.unionByName(rows.select(*self.schema.names)))

    def upsert(self, updates: DataFrame, order) -> None:
        self._rewrite(updates, lambda cur: write_upsert(cur, updates, list(self.key), order))

    def merge(self, updates: DataFrame, order, op: str = "op", delete: str = "D") -> None:
        self._rewrite(updates, lambda cur: write_merge(cur, updates, list(self.key), order, op, delete))

    def keep_latest(self, rows: DataFrame) -> None:
        """Fold rows in by the table's own order column: the greater one wins, whatever the order
        of arrival, so a replayed or late change has no effect."""
        self._rewrite(
            rows,
            lambda cur: latest_by_key(
                cur.unionByName(rows.select(*self.schema.names)), list(self.key), self.order
            ),
        )

    def _rewrite(self, changes: DataFrame, combine) -> None:
        spark = changes.sparkSession
        touched = self._touched(changes)
        if not touched:
            return
        keep, version = self._mapping(spark)
        current = self.read(spark, touched, raw=True)
        self._write(combine(current), touched, keep, version)
