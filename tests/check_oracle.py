"""Run queries() against oracle_sql() on one scale folder and report differences.

Usage: python tests/check_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 9)
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf, query, sql):
    df = query(spark, sf)
    cols = df.columns
    got = rows_of(cols, [tuple(r) for r in df.collect()])
    if sql is None:
        return "rows-only", len(got), 0.0
    t = time.time()
    res = con.execute(sql)
    ocols = [d[0] for d in res.description]
    if sorted(cols) != sorted(ocols):
        return f"COLUMNS {sorted(cols)} vs {sorted(ocols)}", len(got), 0.0
    want = rows_of(ocols, res.fetchall())
    t = time.time() - t
    if got == want:
        return ("ok" if got else "EMPTY on both sides"), len(got), t
    diff = [(g, w) for g, w in zip(got, want) if g != w][:2]
    return f"DIFF {len(got)} vs {len(want)} rows; first {diff}", len(got), t


def main(argv):
    import duckdb

    import __spark_entry__ as entry
    from eventide.session import build_session

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session()
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    queries, oracle = entry.queries(), entry.oracle_sql()
    names = argv[1:] or list(queries)
    bad = 0
    for name in names:
        t = time.time()
        try:
            msg, n, osec = compare(spark, con, sf, queries[name], oracle.get(name))
        except Exception as e:  # keep going: the report lists every failure
            msg, n, osec = f"ERROR {type(e).__name__}: {str(e)[:600]}", -1, 0.0
        bad += msg not in ("ok", "rows-only")
        print(f"{name:34s} {n:8d} rows {time.time() - t:6.1f}s (sql {osec:5.1f}s)  {msg}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
