"""Schema discovery, key checks, fingerprints, drift and evolution."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.functions.names import is_qualified, normalize_tables, quote_qualified_table
from tablesync.model import CATALOG, FULL
from tablesync.session import local_frame

AUTO_APPLY, IGNORE, PAUSE = "auto-apply", "ignore", "pause"
# Change kinds and resolutions of a schema event.
ADDITIVE, BREAKING, UNKNOWN = "additive", "breaking", "unknown"
RESOLUTIONS = {AUTO_APPLY: "auto_applied", IGNORE: "ignored", PAUSE: "paused"}


def catalog_rows(name: str, schema: T.StructType) -> list[tuple]:
    full = normalize_tables([name])[0]
    first, second = full.split(".")
    return [
        (first, second, full, i, f.name, f.dataType.simpleString(), f.nullable)
        for i, f in enumerate(schema, 1)
    ]


def catalog_of(spark: SparkSession, schemas: dict[str, T.StructType]) -> DataFrame:
    """Column catalog of known schemas: one row per column, nothing is scanned."""
    rows = [r for name in sorted(schemas) for r in catalog_rows(name, schemas[name])]
    return local_frame(spark, rows, CATALOG)


def discover_columns(tables: dict[str, DataFrame], observe_nulls: bool = False) -> DataFrame:
    """Columns of each table in ordinal order.

    Files declare nearly every column nullable. With ``observe_nulls`` a column counts as
    nullable only if it also holds a null: one aggregation per table, one row out of each.
    """
    spark = next(iter(tables.values())).sparkSession
    catalog = catalog_of(spark, {n: df.schema for n, df in tables.items()})
    if not observe_nulls:
        return catalog
    observed = None
    for name, df in sorted(tables.items()):
        full = normalize_tables([name])[0]
        flags = F.array(*[
            F.struct(
                F.lit(c).alias("column_name"),
                F.coalesce(F.max(F.col(f"`{c}`").isNull()), F.lit(False)).alias("has_null"),
            )
            for c in df.columns
        ])
        rows = df.agg(flags.alias("flags")).select(
            F.lit(full).alias("fully_qualified_name"), F.inline("flags")
        )
        observed = rows if observed is None else observed.unionByName(rows)
    joined = catalog.join(observed, ["fully_qualified_name", "column_name"])
    nullable = F.col("is_nullable") & F.col("has_null")
    return joined.withColumn("is_nullable", nullable).select(*CATALOG.names)


def discover_tables(spark: SparkSession, names) -> DataFrame:
    """Catalog of tables known to the session; a missing one is an error."""
    names = normalize_tables(names)
    missing = [n for n in names if not spark.catalog.tableExists(n)]
    if missing:
        raise LookupError(f"no table {missing[0]} in this session")
    return discover_columns({n: spark.table(n) for n in names})


def declared_keys(spark: SparkSession, keys: dict[str, list[str]]) -> DataFrame:
    """Key columns in order, as the caller declares them for sources without a key catalog."""
    rows = [
        (normalize_tables([name])[0], i, c)
        for name, columns in sorted(keys.items())
        for i, c in enumerate(columns, 1)
    ]
    return local_frame(spark, rows, "fully_qualified_name string, ordinal int, column_name string")


def verify_key(df: DataFrame, key) -> DataFrame:
    """Groups that break a declared key: several rows, or a null key column.

    Rows are counted on the map side, so a value that fills much of the table costs one row per
    task in the shuffle.
    """
    has_null = F.lit(False)
    for c in key:
        has_null = has_null | F.col(c).isNull()
    return (
        df.groupBy(*key).agg(F.count("*").alias("row_count"))
        .withColumn("problem", F.when(has_null, "null key").when(F.col("row_count") > 1, "duplicate"))
        .filter(F.col("problem").isNotNull())
    )


def missing_tables(requested: DataFrame, catalog: DataFrame) -> DataFrame:
    """Requested ``(position, table_name)`` not in the catalog, in request order.

    Malformed names never match a catalog entry, so they count as missing.
    """
    known = catalog.select(F.col("fully_qualified_name").alias("table_name")).distinct()
    return requested.join(known, "table_name", "left_anti").orderBy("position")


def snapshot_plan(tables: DataFrame, chunk_size: int | None = None, mode: str = FULL) -> DataFrame:
    """Planned snapshot statement per table name; nothing is read from the tables."""
    name = F.col("table_name")
    bad = F.raise_error(F.concat(name, F.lit(" is not a schema.table name")))
    sql = F.concat(F.lit("SELECT * FROM "), quote_qualified_table(name))
    return tables.select(
        name.alias("table"),
        F.when(is_qualified(name), sql).otherwise(bad.cast("string")).alias("sql"),
        F.lit(chunk_size).cast("bigint").alias("chunk_size"),
        F.lit(mode).alias("mode"),
    )


# ---------------------------------------------------------------- fingerprint and drift


def schema_text(schema: T.StructType) -> str:
    """Canonical form: ordered ``name:type:nullable``, one column per line."""
    return "\n".join(
        f"{f.name}:{f.dataType.simpleString()}:{str(f.nullable).lower()}" for f in schema
    )


def schema_fingerprint(schema: T.StructType) -> str:
    return hashlib.sha256(schema_text(schema).encode()).hexdigest()


def fingerprint_column(schema: T.StructType) -> Column:
    return F.sha2(F.lit(schema_text(schema)), 256)


# Families of types whose members hold ever larger values.
WIDTHS = {
    "tinyint": ("integer", 1), "smallint": ("integer", 2), "int": ("integer", 4),
    "bigint": ("integer", 8), "float": ("float", 4), "double": ("float", 8),
    "date": ("time", 1), "timestamp_ntz": ("time", 2), "timestamp": ("time", 2),
}


def _width(dtype: Column) -> tuple[Column, Column]:
    """Family and size of a type name; decimals are sized by integer and fraction digits."""
    family, size = F.lit(None).cast("string"), F.lit(None).cast("int")
    for name, (fam, width) in WIDTHS.items():
        family = F.when(dtype == name, fam).otherwise(family)
        size = F.when(dtype == name, width).otherwise(size)
    return family, size


def _narrowed(old: Column, new: Column) -> Column:
    old_family, old_size = _width(old)
    new_family, new_size = _width(new)
    digits = lambda t, i: F.regexp_extract(t, r"^decimal\((\d+),(\d+)\)$", i).try_cast("int")
    decimal = (
        (digits(new, 1) - digits(new, 2) < digits(old, 1) - digits(old, 2))
        | (digits(new, 2) < digits(old, 2))
    )
    same_family = (old_family == new_family) & (new_size < old_size)
    return F.coalesce(same_family, F.lit(False)) | F.coalesce(decimal, F.lit(False))


def schema_diff(
    old: DataFrame, new: DataFrame, additive: str = PAUSE, breaking: str = PAUSE
) -> DataFrame:
    """Differences between two column catalogs, one row per changed column.

    A new column is additive; a removed column (a rename removes one and adds one) or a narrowed
    type is breaking; any other change of type is unknown and stays ``detected``.
    """
    left = old.select(F.col("fully_qualified_name").alias("stream"), "column_name",
                      F.col("data_type").alias("old_type"))
    right = new.select(F.col("fully_qualified_name").alias("stream"), "column_name",
                       F.col("data_type").alias("new_type"))
    pairs = left.join(right, ["stream", "column_name"], "full")
    kind = (
        F.when(F.col("old_type").isNull(), ADDITIVE)
        .when(F.col("new_type").isNull(), BREAKING)
        .when(F.col("old_type") == F.col("new_type"), None)
        .when(_narrowed(F.col("old_type"), F.col("new_type")), BREAKING)
        .otherwise(UNKNOWN)
    )
    resolution = (
        F.when(F.col("change_type") == ADDITIVE, RESOLUTIONS[additive])
        .when(F.col("change_type") == BREAKING, RESOLUTIONS[breaking])
        .otherwise("detected")
    )
    return (
        pairs.withColumn("change_type", kind)
        .filter(F.col("change_type").isNotNull())
        .withColumn("resolution", resolution)
        .select("stream", F.col("column_name").alias("column"), "old_type", "new_type",
                "change_type", "resolution")
    )


class SchemaPaused(ValueError):
    """A schema change whose policy is to stop."""


def evolve_schema(
    target: DataFrame, incoming: DataFrame, additive: str = PAUSE, breaking: str = PAUSE
) -> tuple[DataFrame, DataFrame]:
    """Bring target and incoming rows to one schema under the drift policies.

    New columns are added to the target as nulls (``auto-apply``), dropped (``ignore``) or
    refused (``pause``). Removed columns stay and are null in the new rows, and narrowed ones
    keep the target's type (``ignore``), or are refused (``pause``). Any other change of type is
    refused. Only the two schemas are compared; no row is read.
    """
    if additive not in RESOLUTIONS or breaking not in (IGNORE, PAUSE):
        raise ValueError(f"unknown drift policy {additive!r}/{breaking!r}")
    old = {f.name: f.dataType for f in target.schema}
    new = {f.name: f.dataType for f in incoming.schema}
    added = [c for c in new if c not in old]
    removed = [c for c in old if c not in new]
    retyped = [c for c in old if c in new and old[c] != new[c]]
    if added and additive == PAUSE:
        raise SchemaPaused(f"new columns: {', '.join(added)}")
    for c in retyped:
        if not _is_narrower(old[c], new[c]):
            raise SchemaPaused(
                f"column {c} changed from {old[c].simpleString()} to {new[c].simpleString()}"
            )
    if (removed or retyped) and breaking == PAUSE:
        raise SchemaPaused(f"removed or narrowed columns: {', '.join(removed + retyped)}")
    extra = added if additive == AUTO_APPLY else []
    wide = target.withColumns({c: F.lit(None).cast(new[c]) for c in extra}) if extra else target
    columns = [*old, *extra]
    fitted = incoming.select(*[
        (F.col(f"`{c}`") if c in new else F.lit(None)).cast(old.get(c) or new[c]).alias(c)
        for c in columns
    ])
    return wide.select(*[F.col(f"`{c}`") for c in columns]), fitted


def _is_narrower(old: T.DataType, new: T.DataType) -> bool:
    if isinstance(old, T.DecimalType) and isinstance(new, T.DecimalType):
        whole = new.precision - new.scale <= old.precision - old.scale
        return whole and new.scale <= old.scale
    a, b = WIDTHS.get(old.simpleString()), WIDTHS.get(new.simpleString())
    return bool(a and b and a[0] == b[0] and b[1] < a[1])
