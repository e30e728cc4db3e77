"""Run registered queries in Spark and their oracle SQL in DuckDB, compare.

Usable from the tests and as a script:
    python tests/oracle_check.py /root/testdata/sf0.01 [key ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _canon(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return repr(v)
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f") if v == v else "NULL"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if hasattr(v, "item"):  # numpy scalar
        return _canon(v.item())
    return str(v)


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    rows = sorted(tuple(_canon(r[i]) for i in order) for r in records)
    return cols, rows


def spark_rows(df):
    recs = [tuple(r) for r in df.collect()]
    return rows_of(df.columns, recs)


def duck_rows(con, sql):
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    return rows_of(cols, cur.fetchall())


def compare(spark, sf_dir, keys=None, verbose=True):
    sys.path.insert(0, ROOT)
    import __spark_entry__ as E

    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for k in keys or list(qs):
        t0 = time.time()
        try:
            sc, sr = spark_rows(qs[k](spark, sf_dir))
        except Exception as e:  # noqa: BLE001
            results[k] = f"SPARK ERROR {type(e).__name__}: {str(e)[:300]}"
            continue
        t1 = time.time()
        if k not in sqls:
            results[k] = f"rows={len(sr)} (no oracle)"
            continue
        try:
            dc, dr = duck_rows(con, sqls[k])
        except Exception as e:  # noqa: BLE001
            results[k] = f"DUCK ERROR {type(e).__name__}: {str(e)[:300]}"
            continue
        if sc != dc:
            results[k] = f"COLUMNS differ spark={sc} duck={dc}"
        elif sr != dr:
            diff_s = [r for r in sr if r not in set(dr)][:3]
            diff_d = [r for r in dr if r not in set(sr)][:3]
            results[k] = f"VALUES differ rows {len(sr)} vs {len(dr)}; spark-only {diff_s}; duck-only {diff_d}"
        else:
            results[k] = f"OK rows={len(sr)} spark={t1 - t0:.2f}s"
        if verbose:
            print(f"{k}: {results[k]}", flush=True)
    return results


if __name__ == "__main__":
    from shopmetrics.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:] or None
    spark = build_session("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    res = compare(spark, sf, keys)
    bad = {k: v for k, v in res.items() if not v.startswith("OK") and "no oracle" not in v}
    print(f"\n{len(res) - len(bad)}/{len(res)} ok")
    for k, v in bad.items():
        print("FAIL", k, v)
