"""Compare registered queries with their SQL twins: python tools/check.py [sf_dir] [name ...]"""

import glob
import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from panelspark.registry import ORACLE, QUERIES  # noqa: E402
from panelspark.session import build_session  # noqa: E402


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith(("datetime", "date")) or df[c].map(type).astype(str).str.contains("date").any():
            df[c] = pd.to_datetime(df[c]).dt.strftime("%Y-%m-%d")
    return df.sort_values(list(df.columns), key=lambda s: s.astype(str)).reset_index(drop=True)


def differ(a: pd.DataFrame, b: pd.DataFrame) -> str:
    a, b = normal(a), normal(b)
    if list(a.columns) != list(b.columns):
        return f"columns {list(a.columns)} vs {list(b.columns)}"
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    bad = []
    for c in a.columns:
        if a[c].dtype != b[c].dtype and not (a[c].isna().all() or b[c].isna().all()):
            bad.append(f"type of {c}: {a[c].dtype} vs {b[c].dtype}")
    x, y = a.map(lambda v: None if pd.isna(v) else str(v)), b.map(lambda v: None if pd.isna(v) else str(v))
    same = (x == y) | (x.isna() & y.isna())
    for c in a.columns:
        if not same[c].all():
            i = (~same[c]).idxmax()
            bad.append(f"{c}: {(~same[c]).sum()} of {len(a)} differ, first {a[c][i]!r} vs {b[c][i]!r}")
    return "; ".join(bad)


def main() -> None:
    args = sys.argv[1:]
    sf = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    failed = []
    for name in args or QUERIES:
        t = time.time()
        try:
            got = QUERIES[name](spark, sf).toPandas()
            mid = time.time()
            if name not in ORACLE:
                note = "no SQL twin"
            else:
                note = differ(got, con.execute(ORACLE[name]).fetchdf()) or "match"
        except Exception as e:
            note, got, mid = f"ERROR {str(e)[:600]}", [], time.time()
        if note not in ("match", "no SQL twin"):
            failed.append(name)
        print(f"{name:28s} {mid - t:6.2f}s {time.time() - mid:6.2f}s {len(got):7d} rows  {note}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
