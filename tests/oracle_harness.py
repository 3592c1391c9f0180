"""Run a registered query in Spark and its oracle SQL in DuckDB on the same
parquet tables; compare row count, column names/kinds and values."""
from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


STRICT = False


def _norm(v):
    if v is None or v is pd.NA:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v if STRICT else round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _frame(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    rows = [tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark, name: str, sf_dir: str, queries: dict, sql: dict) -> tuple[bool, str]:
    t0 = time.time()
    sdf = queries[name](spark, sf_dir)
    s_pd = sdf.toPandas()
    t1 = time.time()
    d_pd = duck(sf_dir).execute(sql[name]).df()
    if sorted(s_pd.columns) != sorted(d_pd.columns):
        return False, f"columns differ: spark={sorted(s_pd.columns)} duck={sorted(d_pd.columns)}"
    if len(s_pd) != len(d_pd):
        return False, f"row count spark={len(s_pd)} duck={len(d_pd)}"
    a, b = _frame(s_pd), _frame(d_pd)
    for i, (x, y) in enumerate(zip(a, b)):
        if x != y:
            return False, f"row {i} differs:\n spark={x}\n duck ={y}\n cols={sorted(s_pd.columns)}"
    return True, f"{len(s_pd)} rows ok ({t1 - t0:.1f}s spark)"


def main(argv):
    sys.path.insert(0, ".")
    from __spark_entry__ import oracle_sql, queries
    from riskloom.session import build_session
    global STRICT
    if "--strict" in argv:
        STRICT = True
        argv = [a for a in argv if a != "--strict"]
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:] or list(oracle_sql())
    spark = build_session()
    q, s = queries(), oracle_sql()
    bad = 0
    for n in names:
        try:
            ok, msg = compare(spark, n, sf, q, s)
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"ERROR {type(e).__name__}: {str(e)[:800]}"
        bad += not ok
        print(f"{'PASS' if ok else 'FAIL'} {n}: {msg}", flush=True)
    print(f"{len(names) - bad}/{len(names)} passed")


if __name__ == "__main__":
    main(sys.argv)
