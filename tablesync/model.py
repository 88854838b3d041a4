"""Column layouts and constants shared by every operator."""

from pyspark.sql import types as T

CONTENT_TYPE = "application/x-ndjson"
CONTENT_ENCODING = "gzip"
DEFAULT_PARTITION = "default"
DEFAULT_RAW_SCHEMA = "tablesync_raw"
DEFAULT_RAW_PREFIX = "raw_"

FULL, INCREMENTAL, NONE = "full", "incremental", "none"
MODES = (FULL, INCREMENTAL, NONE)

_TYPES = {
    "string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(),
    "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
}


def _schema(text: str) -> T.StructType:
    """Like ``StructType.fromDDL``, which needs a running session."""
    pairs = (column.split() for column in text.split(","))
    return T.StructType([T.StructField(name, _TYPES[dtype]) for name, dtype in pairs])


MANIFEST = _schema(
    "pipeline_name string, stream_name string, partition_key string, sequence bigint, "
    "bucket string, object_key string, bytes_written bigint, row_count bigint, "
    "content_type string, content_encoding string, schema_fingerprint string, "
    "created_at_unix_ms bigint, content_hash string, file_count bigint, "
    "max_file_bytes bigint, attempt string"
)

PROGRESS = _schema(
    "table_name string, next_sequence bigint, finished boolean, rows_emitted bigint, "
    "max_cursor_value string, cursor_type string, last_key string"
)

LEDGER = _schema(
    "pipeline_name string, table_name string, next_sequence bigint, rows_staged bigint, "
    "last_chunk_key string, completed boolean, updated_at_unix_ms bigint, "
    "last_cursor_value string, cursor_type string, last_key string"
)

APPLIED = _schema(
    "object_key string, pipeline_name string, stream_name string, sequence bigint, "
    "row_count bigint, loaded_at timestamp, content_hash string, _load_id string"
)

REPORT = _schema(
    "object_key string, table_name string, rows_written bigint, skipped boolean"
)

CATALOG = _schema(
    "schema string, name string, fully_qualified_name string, ordinal int, "
    "column_name string, data_type string, is_nullable boolean"
)

CHANGE_COLUMNS = ("op", "lsn")


def select_as(df, schema):
    """Project ``df`` onto ``schema``; columns it lacks become nulls."""
    from pyspark.sql import functions as F

    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )
