"""Compare queries with their SQL checks: ``python tests/check.py [-d sf] name...``"""

from __future__ import annotations

import argparse
import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def kind(series: pd.Series) -> str:
    k = series.dtype.kind
    return {"i": "int", "u": "int", "f": "float", "b": "bool", "M": "time"}.get(k, "obj")


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "O":
            df[c] = df[c].map(lambda v: None if v is None or (isinstance(v, float) and np.isnan(v)) else str(v))
    return df.sort_values(list(df.columns), na_position="first", kind="stable").reset_index(drop=True)


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    a, b = normal(got), normal(want)
    for c in a.columns:
        if len(a) and kind(a[c]) != kind(b[c]) and not (a[c].isna().any() and {kind(a[c]), kind(b[c])} <= {"int", "float"}):
            return f"type of {c}: {a[c].dtype} vs {b[c].dtype}"
        x, y = a[c], b[c]
        if kind(x) == "float":
            bad = ~((x == y) | (x.isna() & y.isna()))
        else:
            bad = ~((x == y) | (x.isna() & y.isna()))
        if bad.any():
            i = bad.to_numpy().nonzero()[0][0]
            return f"{int(bad.sum())} values of {c}, first {x[i]!r} vs {y[i]!r}; row {a.iloc[i].to_dict()} | {b.iloc[i].to_dict()}"
    return None


def check(spark, con, name: str, queries, oracles, sf_dir: str) -> tuple[str | None, int, float, float]:
    t0 = time.time()
    got = queries[name](spark, sf_dir).toPandas()
    t1 = time.time()
    if name not in oracles:
        return None, len(got), t1 - t0, 0.0
    want = con.execute(oracles[name]).fetchdf()
    return differences(got, want), len(got), t1 - t0, time.time() - t1


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("-d", default="/root/testdata/sf0.01")
    ap.add_argument("-t", type=float, default=0, help="only print slower than this, or failing")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    import __spark_entry__ as entry
    from mcid.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    con = duck(args.d)
    names = [n for n in queries if not args.names or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args.names)]
    failed = 0
    for name in names:
        try:
            diff, rows, ts, td = check(spark, con, name, queries, oracles, args.d)
        except Exception as e:  # report and go on
            diff, rows, ts, td = f"{type(e).__name__}: {str(e)[:600]}", 0, 0, 0
        bad = diff is not None
        failed += bad
        if bad or rows == 0 or ts >= args.t:
            tag = "FAIL" if bad else ("ok  " if name in oracles else "rows")
            print(f"{tag} {name:24s} rows={rows} spark={ts:.1f}s duck={td:.1f}s {diff or ''}", flush=True)
    print(f"{len(names)} queries, {failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
