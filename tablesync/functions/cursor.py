"""Cursor values: typed comparison in Spark, text plus type in the ledger."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDERED_TYPES = (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)


def check_cursor_type(dtype: T.DataType) -> None:
    if not isinstance(dtype, ORDERED_TYPES):
        raise TypeError(f"{dtype.simpleString()} columns have no order to resume by; choose a numeric, text or time column")


def cursor_text(value: Column, dtype: T.DataType) -> Column:
    """Lossless text of a cursor; zoned timestamps go through microseconds, so the session
    time zone of the reader does not matter."""
    check_cursor_type(dtype)
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(value).cast("string")
    return value.cast("string")


def cursor_literal(text, dtype: T.DataType) -> Column:
    """Typed literal; constant-folded, so comparisons with it reach the scan."""
    check_cursor_type(dtype)
    if isinstance(text, (dict, list, bool, bytes)) or text is None:
        raise TypeError(f"cursor value must be a number or string, got: {text!r}")
    if isinstance(dtype, T.TimestampType):
        if str(text).lstrip("-").isdigit():
            return F.timestamp_micros(F.lit(int(text)))
        return F.lit(str(text)).cast(dtype)
    return F.lit(str(text)).cast(dtype)


def newer_cursor(new: Column, old: Column, dtype: Column) -> Column:
    """The greater of two cursors stored as text, compared as ``dtype`` (a column of type names).

    Whole numbers, decimals and microseconds compare as decimals and so keep all their digits;
    dates, times and text are ordered as they are written. A cursor of an unknown type yields to
    the new one, as does any to one it cannot be compared with.
    """
    exact = "tinyint|smallint|int|bigint|timestamp|decimal.*"
    number = lambda c, t: c.try_cast(t)
    greater = (
        F.when(dtype.isNull(), F.lit(True))
        .when(dtype.rlike(f"^({exact})$"), F.coalesce(
            number(new, "decimal(38,18)") >= number(old, "decimal(38,18)"),
            number(new, "decimal(38,0)") >= number(old, "decimal(38,0)"),
        ))
        .when(dtype.rlike("^(float|double)$"), number(new, "double") >= number(old, "double"))
        .otherwise(new >= old)
    )
    return F.when(new.isNull(), old).when(old.isNull(), new).when(F.coalesce(greater, F.lit(True)), new).otherwise(old)


def cursor_predicate(column: str, dtype: T.DataType, last, overlap=None) -> Column:
    """``column > last``; with ``overlap`` the window reaches back by that much."""
    bound = cursor_literal(last, dtype)
    if overlap is not None:
        step = F.expr(overlap) if isinstance(overlap, str) else F.lit(overlap)
        bound = (bound - step).cast(dtype)
    return F.col(column) > bound
