"""Rows to JSON lines and back, and order-free content digests."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Microsecond formats: Spark's JSON default is milliseconds and would lose digits. Spark refuses
# strings of 20 million characters unless told otherwise.
JSON_OPTIONS = {
    "maxStringLen": str((1 << 31) - 1),
    "ignoreNullFields": "false",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
}
# Parsing of lines that are to be JSON and nothing else.
STRICT = {**JSON_OPTIONS, "allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "mode": "PERMISSIVE"}
_SENTINEL = "\u2402end of line\u2403"
_INTERVALS = (T.DayTimeIntervalType, T.YearMonthIntervalType, T.CalendarIntervalType)


def record_column(df: DataFrame, columns=None, json_columns=(), row: str | None = None) -> Column:
    """One JSON object per row, nulls kept; ``json_columns`` are embedded, not quoted.

    The columns are those of ``df`` or, with ``row``, the fields of that struct column.
    """
    schema = df.schema if row is None else df.schema[row].dataType
    columns = list(columns or schema.names)
    for name in columns:
        if isinstance(schema[name].dataType, _INTERVALS):
            raise TypeError(f"column {name} has an interval type, which has no JSON form")
    at = lambda c: F.col(f"`{c}`") if row is None else F.col(row).getField(c).alias(c)
    plain = lambda names: F.to_json(F.struct(*map(at, names)), JSON_OPTIONS)
    if not json_columns:
        return F.to_json(F.col(row), JSON_OPTIONS) if row is not None and columns == schema.names else plain(columns)
    parts = []
    for name in columns:
        if name in json_columns:
            # A valid document has line breaks only between its tokens.
            text = F.translate(checked_json(at(name)), "\r\n", "  ")
            label = F.lit(json.dumps(name, ensure_ascii=False) + ":")
            parts.append(F.concat(label, F.coalesce(text, F.lit("null"))))
        else:
            field = plain([name])
            parts.append(F.substring(field, F.lit(2), F.length(field) - 2))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def encode_rows(df: DataFrame, columns=None, json_columns=(), keep=()) -> DataFrame:
    return df.select(*keep, record_column(df, columns, json_columns).alias("record"))


def strip(value: Column) -> Column:
    return F.trim(value, F.lit(" \t\r\n\f\u000b"))


def not_blank(value: Column) -> Column:
    return strip(value) != ""


def checked_json(value: Column) -> Column:
    """``value`` itself when it is one JSON value of any size and kind; otherwise the job fails.

    In a list before a mark of our own, one value gives exactly two elements with the mark last.
    Text after the value, a second value, a closing bracket or a cut value do not, and single quotes
    and bare ``NaN`` are no JSON.
    """
    mark = json.dumps(_SENTINEL)
    listed = F.from_json(F.concat(F.lit("["), value, F.lit(f",{mark}]")), "array<string>", STRICT)
    good = (F.size(listed) == 2) & (F.get(listed, F.lit(1)) == _SENTINEL)
    return F.when(value.isNotNull() & ~F.coalesce(good, F.lit(False)), _refused(value)).otherwise(value)


def _refused(value: Column) -> Column:
    return F.raise_error(F.concat(F.lit("invalid staged JSON line: "), F.left(value, F.lit(200))))


def decode_lines(lines: DataFrame, schema: T.StructType | None = None, column: str = "value"):
    """Blank lines dropped, the rest parsed; a malformed line fails the job."""
    value = checked_json(strip(F.col(column)))
    rows = lines.filter(not_blank(F.col(column)))
    return rows.withColumn(column, F.parse_json(value) if schema is None else _from_json(value, schema))


def _from_json(value: Column, schema: T.StructType) -> Column:
    """Typed value of one JSON line; text after it is an error, as it is for ``checked_json``."""
    return _whole_line(value, _marked(value, schema), schema)


def _marked(value: Column, schema: T.StructType) -> Column:
    """The line as a field before a mark of our own, so the mark is lost if anything follows the value."""
    shape = T.StructType([T.StructField("line", schema), T.StructField("mark", T.StringType())])
    text = F.concat(F.lit('{"line":'), value, F.lit(f',"mark":{json.dumps(_SENTINEL)}}}'))
    return F.from_json(text, shape, {**JSON_OPTIONS, "allowSingleQuotes": "false", "mode": "FAILFAST"})


def _whole_line(value: Column, parsed: Column, schema: T.StructType) -> Column:
    whole = parsed.getField("mark").eqNullSafe(F.lit(_SENTINEL))
    line = parsed.getField("line")
    return F.when(value.isNotNull() & ~whole, _refused(value).cast(schema)).otherwise(line)


def project_typed(raw: DataFrame, schema: T.StructType, column: str = "_data", keep=()):
    """Typed columns back out of a raw table's JSON column, behind the ``keep`` columns."""
    # a projection of its own, so that a line is parsed once and not for the mark and for the value
    kept = [F.struct(*keep).alias("_kept")] if keep else []
    marked = raw.select(*kept, F.col(column).alias("_text"), _marked(F.col(column), _nullable(schema)).alias("_parsed"))
    typed = _whole_line(F.col("_text"), F.col("_parsed"), _nullable(schema)).alias("_typed")
    parsed = marked.select("_kept", typed) if keep else marked.select(typed)
    kept = [F.col("_kept").getField(k).alias(k) for k in keep]
    return parsed.select(*kept, *[F.col("_typed").getField(c).alias(c) for c in schema.names])


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def content_digest(value: Column) -> Column:
    """Order-free digest of a group of strings.

    Both halves of the 64-bit hash are summed apart, so neither sum can overflow and copies
    do not cancel; partial sums combine on the map side.
    """
    h = F.xxhash64(value)
    return F.concat_ws(
        "-",
        F.hex(F.count(value)),
        F.hex(F.coalesce(F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))), F.lit(0))),
        F.hex(F.coalesce(F.sum(F.shiftrightunsigned(h, 32)), F.lit(0))),
    )
