"""Runs registered queries and their SQL twins side by side and compares all values."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def canonical(pdf: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, every value as text, rows sorted."""

    def text(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, pd.Timestamp):
            return v.isoformat()
        if isinstance(v, float):
            return repr(int(v)) if v == int(v) else f"{v:.9g}"
        return str(v)

    out = pdf[sorted(pdf.columns)].astype(object).map(text)
    return out.sort_values(list(out.columns), na_position="first").reset_index(drop=True)


def compare(spark, con, sf: str, name: str, query, sql: str) -> str | None:
    """None when both sides agree, else what differs."""
    got = canonical(query(spark, sf).toPandas())
    want = canonical(con.execute(sql).df())
    if list(got.columns) != list(want.columns):
        return f"columns {list(got.columns)} != {list(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    unequal = (got.fillna("\0") != want.fillna("\0")).any(axis=1)
    if unequal.any():
        return f"{int(unequal.sum())} rows differ\n{got[unequal].head(3)}\n{want[unequal].head(3)}"
    return None


if __name__ == "__main__":
    from conftest import make_session

    from __spark_entry__ import oracle_sql, queries

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = make_session(), duck(sf)
    sqls, failed = oracle_sql(), []
    for name, query in queries().items():
        if sys.argv[1:] and name not in sys.argv[1:]:
            continue
        start = time.time()
        try:
            problem = compare(spark, con, sf, name, query, sqls[name]) if name in sqls else query(spark, sf).limit(0).count() or None
        except Exception as e:  # report and go on
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s", flush=True)
        if problem is not None:
            failed.append(name)
            print(problem, flush=True)
    print("failed:", failed)
