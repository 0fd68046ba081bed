"""Compare a query with its SQL: ``python -m tests.oracle SF_DIR [NAME...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        where = f"{p}/*.parquet" if p.is_dir() else str(p)
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{where}')")
    return c


def tidy(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for k in df.columns:
        if df[k].dtype.kind in "fiub" or df[k].map(lambda x: x is None or isinstance(x, (int, float, np.number)) or type(x).__name__ == "Decimal").all():
            df[k] = pd.to_numeric(df[k].map(lambda x: np.nan if x is None or x is pd.NA else float(x)))
        else:
            df[k] = df[k].map(lambda x: None if x is None or x is pd.NaT or (isinstance(x, float) and np.isnan(x)) else str(x))
    return df.sort_values(list(df.columns), na_position="last").reset_index(drop=True)


def compare(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame, tol: float = 1e-9) -> str:
    """An empty text if both hold the same rows, else what differs."""
    a, b = tidy(spark_rows), tidy(sql_rows)
    if list(a.columns) != list(b.columns):
        return f"columns {list(a.columns)} and {list(b.columns)}"
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    for k in a.columns:
        x, y = a[k], b[k]
        if x.dtype.kind == "f" and y.dtype.kind == "f":
            same = np.isclose(x, y, rtol=tol, atol=tol, equal_nan=True)
        else:
            same = (x.astype(object).where(x.notna(), None) == y.astype(object).where(y.notna(), None)) | (x.isna() & y.isna())
        if not same.all():
            i = int(np.argmin(np.asarray(same)))
            return f"{(~np.asarray(same)).sum()} rows differ in {k}: {a.loc[i].to_dict()} and {b.loc[i].to_dict()}"
    return ""


def main() -> None:
    import __spark_entry__ as e
    from tests.conftest import session

    spark, d, names = session(), sys.argv[1], sys.argv[2:]
    c, sql = connection(d), e.oracle_sql()
    bad = 0
    for k, f in e.queries().items():
        if names and not any(k == n or (n.endswith("*") and k.startswith(n[:-1])) for n in names):
            continue
        t = time.time()
        try:
            got = f(spark, d).toPandas()
            s = time.time() - t
            said = compare(got, c.execute(sql[k]).df()) if k in sql else f"rows only: {len(got)}"
        except Exception as x:  # noqa: BLE001
            s, said = time.time() - t, "ERROR " + " ".join(str(x).split())[:600]
        bad += bool(said) and not said.startswith("rows only")
        print(f"{k:32s} {s:6.1f} s  {said or 'equal'}", flush=True)
    print("differing:", bad)


if __name__ == "__main__":
    main()
