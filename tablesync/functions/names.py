"""Object keys, identifiers and table names as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesync.model import DEFAULT_PARTITION, DEFAULT_RAW_PREFIX, DEFAULT_RAW_SCHEMA


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def normalize_prefix(prefix) -> Column:
    """Strip white space, then slashes, from both ends."""
    stripped = F.regexp_replace(as_column(prefix), r"(?U)^\s+|\s+$", "")
    return F.btrim(stripped, F.lit("/"))


def chunk_key(pipeline, stream, sequence, partition=DEFAULT_PARTITION, prefix="") -> Column:
    """``[prefix/]pipelines/P/streams/S/partitions/K/chunks/<20 digits>.jsonl.gz``"""
    base = F.format_string(
        "pipelines/%s/streams/%s/partitions/%s/chunks/%020d.jsonl.gz",
        as_column(pipeline),
        as_column(stream),
        as_column(partition),
        as_column(sequence).cast("bigint"),
    )
    clean = normalize_prefix(prefix)
    return F.when(clean == "", base).otherwise(F.concat(clean, F.lit("/"), base))


def sanitize_name(name) -> Column:
    """Every character outside ``[A-Za-z0-9_-]`` becomes ``-`` (ledger folder names)."""
    return F.regexp_replace(as_column(name), "[^A-Za-z0-9_-]", "-")


def sanitize_ident(name) -> Column:
    """Lower-case ASCII identifier: other characters become single ``_``, ends trimmed."""
    return F.btrim(
        F.lower(F.regexp_replace(as_column(name), "[^A-Za-z0-9]+", "_")), F.lit("_")
    )


def quote_ident(name) -> Column:
    return F.concat(F.lit('"'), F.replace(as_column(name), F.lit('"'), F.lit('""')), F.lit('"'))


def quote_qualified_table(name) -> Column:
    parts = F.split(as_column(name), r"\.")
    return F.concat(quote_ident(parts[0]), F.lit("."), quote_ident(parts[1]))


def is_qualified(name) -> Column:
    """True for exactly two non-blank dot-separated parts."""
    parts = F.split(as_column(name), r"\.")
    return (F.size(parts) == 2) & F.forall(parts, lambda p: F.trim(p) != "")


def raw_ident(stream, prefix=DEFAULT_RAW_PREFIX) -> Column:
    """Unquoted raw table name of a stream."""
    return F.concat(as_column(prefix), sanitize_ident(stream))


def raw_table_name(stream, schema=DEFAULT_RAW_SCHEMA, prefix=DEFAULT_RAW_PREFIX) -> Column:
    return F.concat(quote_ident(schema), F.lit("."), quote_ident(raw_ident(stream, prefix)))


def raw_name_collisions(streams: DataFrame, column: str = "stream_name", **names) -> DataFrame:
    """Raw table names that more than one distinct stream maps to."""
    return (
        streams.select(column)
        .distinct()
        .groupBy(raw_table_name(F.col(column), **names).alias("table_name"))
        .agg(F.count("*").alias("streams"))
        .filter("streams > 1")
    )


def check_raw_idents(streams, prefix: str = DEFAULT_RAW_PREFIX) -> None:
    """Refuse a set of stream names of which two would share a raw table."""
    taken: dict[str, str] = {}
    for stream in sorted(streams):
        ident = prefix + re.sub("[^A-Za-z0-9]+", "_", stream).lower().strip("_")
        if taken.setdefault(ident, stream) != stream:
            raise ValueError(f"streams {taken[ident]} and {stream} map to the same raw table {ident}")


def normalize_tables(names) -> list[str]:
    """Trimmed, sorted, de-duplicated ``schema.table`` names; anything else is an error."""
    out = set()
    for name in names:
        parts = [p.strip() for p in name.strip().split(".")]
        if len(parts) != 2 or not all(parts):
            raise ValueError(f"{name.strip()!r} is not a schema.table name")
        out.add(".".join(parts))
    return sorted(out)
