"""Global row numbers and fixed-size chunks without a single-task sort.

A window over the whole table would move every row to one task. Instead the rows are range
partitioned and sorted (or left where the scan put them when no order is asked for), written
once to the shared scratch folder with their per-partition position, and the position becomes a
global index by adding the number of rows in earlier partitions. Only those per-partition counts
reach the driver. Numbers never change afterwards: a lost executor re-reads the written rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.functions.codec import JSON_OPTIONS, record_column
from tablesync.session import join_by_file, local_frame, read_or_none, scratch_path

INDEX, SEQUENCE = "_row_index", "sequence"
# A table's row as one struct column, so that its columns may have any names.
ROW = "_row"
_ID = "_row_id"
# Layout of monotonically_increasing_id: partition number above, position in it below.
_POSITION_BITS = 33


@dataclass(frozen=True)
class Numbered:
    """Rows with their global index, and how many there are."""

    df: DataFrame
    total: int
    path: str | None = None

    def release(self) -> None:
        """Delete the scratch copy, if there is one, once nothing reads it any more."""
        if self.path is None:
            return
        spark = self.df.sparkSession
        jvm = spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(self.path)
        conf = spark._jsc.hadoopConfiguration()
        target.getFileSystem(conf).delete(target, True)


def _has_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, (T.MapType, T.VariantType)):
        return True
    if isinstance(dtype, T.ArrayType):
        return _has_map(dtype.elementType)
    return isinstance(dtype, T.StructType) and any(_has_map(f.dataType) for f in dtype)


def row_hash(df: DataFrame) -> Column:
    """64-bit hash of a whole row; maps cannot be hashed, so those rows hash as JSON."""
    if _has_map(df.schema):
        return F.xxhash64(record_column(df))
    return F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """The names, longer where the table has a column of that name."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def pack(df: DataFrame) -> Column:
    """All columns as one struct column named ``ROW``."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW)


def unpack(df: DataFrame, *keep: str) -> DataFrame:
    """The packed columns, and ``keep`` behind them, which must have other names."""
    names = df.schema[ROW].dataType.names
    clash = {n.lower() for n in names} & {k.lower() for k in keep}
    if clash:
        raise ValueError(f"the table has a column named {', '.join(sorted(clash))}; work on packed rows instead")
    return df.select(*[F.col(ROW).getField(c).alias(c) for c in names], *keep)


def sort_columns(order_by) -> list[Column]:
    return [c if isinstance(c, Column) else F.col(c).asc_nulls_first() for c in order_by]


def number_rows(df: DataFrame, order_by=(), unique: bool = False, packed: bool = False) -> Numbered:
    """Number the rows of ``df`` 0, 1, 2, … in ``order_by`` order (scan order when empty).

    Unless the order is ``unique``, ties are broken by a hash of the row and then by scan
    position, so a key value or a set of identical copies holding much of the table is still
    spread over many range partitions. With ``packed`` the result has the row as one struct.
    """
    spark = df.sparkSession
    row = pack(df)
    rows = df
    if order_by:
        keys = sort_columns(order_by)
        if not unique:
            tie, pos = fresh_names(df, "_tie", "_scan_pos")
            rows = rows.withColumns({tie: row_hash(df), pos: F.monotonically_increasing_id()})
            keys += [F.col(tie), F.col(pos)]
        rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    path = scratch_path(spark, "numbered")
    rows.select(row, F.monotonically_increasing_id().alias(_ID)).write.parquet(path)

    schema = T.StructType([T.StructField(ROW, df.schema), T.StructField(_ID, T.LongType())])
    written = read_or_none(spark, path, schema)
    partition = F.shiftright(_ID, _POSITION_BITS)
    # One row per partition of the write: bounded by the partition count, not by the data.
    counts = sorted(tuple(r) for r in written.groupBy(partition).count().collect())
    ends = list(accumulate(n for _, n in counts))
    offsets = [(p, end - n) for (p, n), end in zip(counts, ends)]
    offset_df = local_frame(spark, offsets, "_partition int, _offset bigint")
    position = F.col(_ID).bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    numbered = (
        written.withColumn("_partition", partition.cast("int"))
        .join(F.broadcast(offset_df), "_partition")
        .select(ROW, (position + F.col("_offset")).alias(INDEX))
    )
    return Numbered(numbered if packed else unpack(numbered, INDEX), ends[-1] if ends else 0, path)


# Chunks whose first keys may become one literal: a key's size each.
MOST_BOUNDS = 1_000_000


def first_keys(df: DataFrame, order_by, chunk_size: int, unique: bool) -> tuple[list[str], T.StructType] | None:
    """The key at which each chunk begins, as JSON text, and the keys' schema.

    Only the keys are sorted and numbered, not the rows; without a ``unique`` order a hash of the
    row is part of the key. None where keys cannot tell the chunks apart, because copies of one row lie
    on both sides of a boundary, or where there are too many chunks. One key per chunk reaches the driver.
    """
    named = key_struct(df, order_by, unique)
    keys = df.select(named.alias("_key"))
    numbered = number_rows(keys, ["_key"], unique, packed=True)  # copies of a row are spread by scan position
    try:
        if numbered.total > MOST_BOUNDS * chunk_size:
            return None
        at = F.col(INDEX) % chunk_size
        edges = numbered.df.filter((at == 0) | (at == chunk_size - 1)).select(
            INDEX, F.to_json(F.col(ROW).getField("_key"), JSON_OPTIONS).alias("key")
        )
        rows = sorted(tuple(r) for r in edges.collect())
    finally:
        numbered.release()
    last = {i: k for i, k in rows}
    starts = [(i, k) for i, k in rows if i % chunk_size == 0]
    if any(i and last[i - 1] == k for i, k in starts):
        return None
    return [k for _, k in starts], keys.schema["_key"].dataType


def key_struct(df: DataFrame, order_by, unique: bool) -> Column:
    """The sort key as one struct, which sorts like its fields, nulls first."""
    columns = [c if isinstance(c, Column) else F.col(f"`{c}`") for c in order_by]
    if not unique:
        columns.append(row_hash(df))
    return F.struct(*[c.alias(f"k{i}") for i, c in enumerate(columns)])


def chunk_of(key: Column, starts: list[str], schema: T.StructType) -> Column:
    """Number of the chunk a key belongs to: a binary search among the chunks' first keys.

    The first keys are one constant of the plan.
    """
    keys = F.from_json(F.lit("[" + ",".join(starts) + "]"), T.ArrayType(schema), {**JSON_OPTIONS, "mode": "FAILFAST"})
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(starts).bit_length()))])
    found = F.aggregate(
        steps, F.lit(0),
        lambda at, step: F.when((at + step <= len(starts)) & (F.get(keys, at + step - 1) <= key), at + step).otherwise(at),
    )
    return (found - 1).cast("bigint")


def file_offsets(counts: DataFrame) -> tuple[DataFrame, int]:
    """Rows in earlier files, by ``_file``, from ``_file, _n``, and the total.

    Two levels: files are sorted in ranges and added up within each; what earlier ranges hold is
    one row per range. No task sees all files.
    """
    spark = counts.sparkSession
    path = scratch_path(spark, "files")
    ranged = counts.repartitionByRange("_file").sortWithinPartitions("_file")
    ranged.select("_file", "_n", F.spark_partition_id().alias("_range")).write.parquet(path)
    files = read_or_none(spark, path, "_file string, _n bigint, _range int")
    totals = sorted(tuple(r) for r in files.groupBy("_range").agg(F.sum("_n")).collect())  # one row per range
    ends = list(accumulate(n for _, n in totals))
    starts = local_frame(spark, [(r, end - n) for (r, n), end in zip(totals, ends)], "_range int, _before bigint")
    earlier = W.partitionBy("_range").orderBy("_file").rowsBetween(W.unboundedPreceding, -1)
    within = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    offsets = files.join(F.broadcast(starts), "_range").select("_file", (within + F.col("_before")).alias("_offset"))
    return offsets, ends[-1] if ends else 0


def number_files(spark: SparkSession, path: str, packed: bool = False) -> Numbered:
    """Number the rows of a parquet folder by file name and position in the file.

    The reader knows each row's position, so nothing is sorted, shuffled or copied: the row
    counts, which the footers hold, give every file its offset. The files must stay as they are
    until the rows are written.
    """
    table = spark.read.parquet(path)
    about = table.metadataColumn("_metadata")
    rows = table.select(pack(table), about.getField("file_path").alias("_file"), about.getField("row_index").alias("_pos"))
    # One row per file.
    offsets, total = file_offsets(rows.groupBy("_file").agg(F.count("*").alias("_n")))
    numbered = join_by_file(rows, offsets).select(ROW, (F.col("_pos") + F.col("_offset")).alias(INDEX))
    return Numbered(numbered if packed else unpack(numbered, INDEX), total)


def assign_sequence(numbered: DataFrame, chunk_size: int | None, start_sequence: int = 0):
    """Chunk number of every numbered row; without a size all rows share the first number."""
    if chunk_size is None:
        return numbered.withColumn(SEQUENCE, F.lit(start_sequence).cast("bigint"))
    check_chunk_size(chunk_size)
    return numbered.withColumn(
        SEQUENCE, F.expr(f"{INDEX} div {int(chunk_size)}L") + F.lit(start_sequence).cast("bigint")
    )


def check_chunk_size(chunk_size: int) -> None:
    if chunk_size <= 0:
        raise ValueError("a chunk needs at least one row")


def capture_chunked(
    df: DataFrame, order_by=(), chunk_size: int = 50_000, start_sequence: int = 0,
    unique: bool = False,
) -> DataFrame:
    """Pages of exactly ``chunk_size`` rows (the last may be short), numbered from
    ``start_sequence``; an empty table has no page."""
    check_chunk_size(chunk_size)
    numbered = number_rows(df, order_by, unique, packed=True).df
    return unpack(assign_sequence(numbered, chunk_size, start_sequence), INDEX, SEQUENCE)


def chunk_row_counts(chunked: DataFrame, *extra: str) -> DataFrame:
    """Rows per chunk; the count is combined before its shuffle."""
    return chunked.groupBy(*extra, SEQUENCE).agg(F.count("*").alias("row_count"))
