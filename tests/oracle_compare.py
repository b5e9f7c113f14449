"""Run registered queries in Spark and their oracle SQL in DuckDB; compare
row counts, column names and an order-insensitive hash of the values.

    python tests/oracle_compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(round(v, 6))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    return str(v)


def digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    h = hashlib.sha256()
    for ln in lines:
        h.update(ln.encode())
        h.update(b"\n")
    return h.hexdigest(), lines


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, name, sf_dir, con=None, verbose=True):
    import __spark_entry__ as entry
    con = con or duck(sf_dir)
    t0 = time.time()
    df = entry.queries()[name](spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return {"query": name, "rows": len(s_rows), "oracle": None, "spark_s": round(t1 - t0, 2)}
    rel = con.sql(sql)
    d_cols = rel.columns
    d_rows = rel.fetchall()
    t2 = time.time()
    hs, ls = digest(s_cols, s_rows)
    hd, ld = digest(d_cols, d_rows)
    ok = sorted(s_cols) == sorted(d_cols) and len(s_rows) == len(d_rows) and hs == hd
    res = {"query": name, "ok": ok, "spark_rows": len(s_rows), "duck_rows": len(d_rows),
           "cols_equal": sorted(s_cols) == sorted(d_cols), "spark_s": round(t1 - t0, 2), "duck_s": round(t2 - t1, 2)}
    if not ok and verbose:
        res["spark_cols"], res["duck_cols"] = s_cols, d_cols
        a, b = set(ls), set(ld)
        res["only_spark"] = sorted(a - b)[:5]
        res["only_duck"] = sorted(b - a)[:5]
    return res


def main(argv):
    from corpuskit.session import get_spark
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    import __spark_entry__ as entry
    names = argv[2:] or list(entry.queries())
    spark = get_spark("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, sf_dir, con)
        except Exception as exc:  # report and go on
            r = {"query": n, "ok": False, "error": repr(exc)[:2000]}
        bad += 0 if r.get("ok", True) else 1
        print(r, flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
