"""Table scans: full, cursor-incremental and capped captures."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesync.functions.codec import record_column
from tablesync.functions.cursor import ORDERED_TYPES, cursor_literal, cursor_predicate, cursor_text
from tablesync.functions.names import normalize_tables
from tablesync.operators.chunking import INDEX, fresh_names, number_rows, row_hash, sort_columns, unpack

# Largest cap answered by a top-k scan, whose rows meet in one task. Above it the last key is
# selected by counting.
TOP_K_ROWS = 100_000


def capture_incremental(df: DataFrame, cursor: str, last=None, overlap=None) -> DataFrame:
    """Rows with ``cursor > last``; without ``last`` the whole table, null cursors included.

    Later runs never see null cursors, nor rows that arrive late at or below ``last``; an
    ``overlap`` (an interval expression or a number) re-reads that far back, and the repeats
    can be folded with ``latest_by_key``.
    """
    if last is None:
        return df
    return df.filter(cursor_predicate(cursor, df.schema[cursor].dataType, last, overlap))


def capture_bounded(df: DataFrame, key, max_rows: int, top_k: int | None = None) -> DataFrame:
    """The first ``max_rows`` rows in key order, tied ones by a hash of the row.

    Above ``top_k`` (``TOP_K_ROWS``) the last row's key and hash are selected by counting and the table is
    filtered, not sorted; only copies of that last row are numbered, to take as many as are missing.
    Keys without a lossless text (``cursor_text``) are numbered in order instead.
    """
    keys = [key] if isinstance(key, str) else list(key)
    top_k = TOP_K_ROWS if top_k is None else top_k
    if max_rows <= top_k:
        return df.orderBy(*sort_columns(keys), row_hash(df)).limit(max_rows)
    if not all(isinstance(df.schema[k].dataType, ORDERED_TYPES) for k in keys):
        return unpack(number_rows(df, keys, packed=True).df.filter(F.col(INDEX) < max_rows))
    tie, = fresh_names(df, "_tie")
    hashed = df.withColumn(tie, row_hash(df))
    columns = [*keys, tie]
    found = selected_position(hashed, columns, max_rows, top_k)
    if found is None:
        return df
    position, below = found
    equal = unpack(number_rows(at_key(hashed, position), packed=True).df.filter(F.col(INDEX) < max_rows - below))
    return before_key(hashed, position).unionByName(equal).select(*[F.col(f"`{c}`") for c in df.columns])


def key_position(df: DataFrame, columns, max_rows: int) -> dict[str, str] | None:
    """The key of the ``max_rows``-th row, as lossless text per column.

    None when the table has fewer rows than that. Only a few keys reach the driver.
    """
    keys = df.select(*[F.col(f"`{c}`") for c in columns])
    if max_rows > TOP_K_ROWS:
        found = selected_position(keys, columns, max_rows)
        return None if found is None else found[0]
    return _top_k_position(keys, columns, max_rows)


def _top_k_position(keys: DataFrame, columns, max_rows: int) -> dict[str, str] | None:
    """``key_position`` by a top-k, whose rows meet in one task."""
    first = keys.orderBy(*columns).limit(max_rows)
    summary = first.agg(F.max(F.struct(*columns)).alias("k"), F.count("*").alias("n"))
    row = summary.filter(F.col("n") == max_rows).select("k.*")
    found = row.select(*_position_texts(keys, columns)).collect()
    return found[0].asDict() if found else None


def _position_texts(df: DataFrame, columns) -> list[Column]:
    fields = {f.name: f.dataType for f in df.schema}
    return [cursor_text(F.col(f"`{c}`"), fields[c]).alias(c) for c in columns]


# Keys drawn at random in each round of a selection: each round cuts what is left about that many times.
PIVOTS = 100


def selected_position(df: DataFrame, columns, n: int, top_k: int | None = None) -> tuple[dict[str, str], int] | None:
    """The key of the ``n``-th row in key order and the number of rows with smaller keys.

    Nothing is sorted or shuffled. Each round draws some keys from a bracket of keys that holds the
    wanted one, counts exactly how many rows lie below and at each, and takes the bracket between two
    of them, or the answer if the wanted row is tied with one. Brackets are filters, so they reach the
    scan; the last one, of at most ``top_k`` rows, is answered by a top-k.
    """
    top_k = TOP_K_ROWS if top_k is None else top_k
    keys = df.select(*[F.col(f"`{c}`") for c in columns])
    low = high = None  # positions: the wanted key is above the one and below the other
    below, left = 0, keys.count()
    if left < n:
        return None
    while True:
        bracket = keys
        if low is not None:
            bracket = after_key(bracket, low)
        if high is not None:
            bracket = before_key(bracket, high)
        wanted = n - below
        if min(wanted, left) <= top_k:
            position = _top_k_position(bracket, columns, wanted)
            lits = F.struct(*_key_literals(keys, position))
            return position, below + bracket.filter(F.struct(*columns) < lits).count()
        drawn = bracket.orderBy(F.rand(17)).limit(PIVOTS).distinct().orderBy(*sort_columns(columns))
        pivots = [r.asDict() for r in drawn.select(*_position_texts(keys, columns)).collect()]
        key, counts = F.struct(*columns), []
        for i, p in enumerate(pivots):
            at = F.struct(*_key_literals(keys, p))
            counts += [F.count_if(key < at).alias(f"l{i}"), F.count_if(key <= at).alias(f"e{i}")]
        row = bracket.agg(*counts).first()
        for i, p in enumerate(pivots):
            if wanted <= row[f"l{i}"]:
                high, left = p, row[f"l{i}"] - (row[f"e{i - 1}"] if i else 0)
                break
            if wanted <= row[f"e{i}"]:
                return p, below + row[f"l{i}"]
            low = p
        else:
            left -= row[f"e{len(pivots) - 1}"]
        passed = [row[f"e{i}"] for i, p in enumerate(pivots) if row[f"e{i}"] < wanted]
        below += max(passed, default=0)


def _key_literals(df: DataFrame, position: dict) -> list[Column]:
    return [
        (F.lit(None).cast(df.schema[c].dataType) if v is None
         else cursor_literal(v, df.schema[c].dataType)).alias(c)
        for c, v in position.items()
    ]


def up_to_key(df: DataFrame, position: dict) -> DataFrame:
    """Rows whose key is at or below ``position``, so groups of equal keys stay whole."""
    lits = _key_literals(df, position)
    first = next(iter(position))
    prunable = (F.col(first) <= lits[0]) | F.col(first).isNull()  # reaches the scan
    if len(position) == 1:
        return df.filter(prunable)
    return df.filter(prunable & (F.struct(*position) <= F.struct(*lits)))


def before_key(df: DataFrame, position: dict) -> DataFrame:
    """Rows whose key is below ``position``."""
    lits = _key_literals(df, position)
    first = F.col(f"`{next(iter(position))}`")
    prunable = (first <= lits[0]) | first.isNull()
    return df.filter(prunable & (F.struct(*position) < F.struct(*lits)))


def at_key(df: DataFrame, position: dict) -> DataFrame:
    """Rows whose key is ``position``."""
    same = F.lit(True)
    for c, literal in zip(position, _key_literals(df, position)):
        same = same & F.col(f"`{c}`").eqNullSafe(literal)
    return df.filter(same)


def after_key(df: DataFrame, position: dict) -> DataFrame:
    """Rows whose key is above ``position``; nulls sort first, so none are left behind."""
    lits = _key_literals(df, position)
    first = next(iter(position))
    above = F.struct(*position) > F.struct(*lits)
    if position[first] is None:
        return df.filter(above)
    if len(position) == 1:
        return df.filter(F.col(first) > lits[0])
    return df.filter((F.col(first) >= lits[0]) & above)


def capture_capped(
    df: DataFrame, columns, max_rows: int, counted: DataFrame | None = None
) -> tuple[DataFrame, bool]:
    """About ``max_rows`` rows in key order, plus whether the cap cut the table.

    Rows tied with the last key all come along, and rows with a null key always belong to the
    first capture, so a later run that starts above the last key misses nothing. ``counted`` are
    the rows the cap counts, when it does not count all: rows read again must not use it up.
    """
    columns = [columns] if isinstance(columns, str) else list(columns)
    if max_rows <= 0:
        raise ValueError("max_rows must be greater than zero")
    counted = df if counted is None else counted
    not_null = counted.filter(F.col(columns[0]).isNotNull())
    position = key_position(not_null, columns, max_rows)
    if position is None:
        return df, False
    cut = bool(after_key(df, position).limit(1).collect())
    return up_to_key(df, position), cut


def position_text(position: dict | None) -> str | None:
    return None if position is None else json.dumps(position)


def position_from_text(text: str | None) -> dict | None:
    return None if text is None else json.loads(text)


def last_position(schema, columns, at=F.col) -> Column:
    """Aggregate: the greatest key as JSON text that ``position_from_text`` reads."""
    fields = {f.name: f.dataType for f in schema}
    top = F.max(F.struct(*[at(c).alias(c) for c in columns]))
    texts = F.struct(*[cursor_text(top[c], fields[c]).alias(c) for c in columns])
    return F.when(F.count("*") > 0, F.to_json(texts, {"ignoreNullFields": "false"}))


def max_cursor(df: DataFrame, cursor: str) -> DataFrame:
    """Greatest non-null cursor, typed; null when there is none."""
    return df.agg(F.max(cursor).alias("max_cursor_value"))


def capture_tables(tables: dict[str, DataFrame], json_columns=()) -> DataFrame:
    """Several tables as one ``(stream_name, record)`` frame, in sorted name order."""
    names = normalize_tables(tables)
    cleaned = {normalize_tables([n])[0]: df for n, df in tables.items()}
    if not names:
        raise ValueError("at least one table must be captured")
    parts = [
        cleaned[n].select(
            F.lit(n).alias("stream_name"), record_column(cleaned[n], json_columns=json_columns).alias("record")
        )
        for n in names
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
