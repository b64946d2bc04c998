"""Run registered queries against their DuckDB twins (like the driver's gate).

Usage: python tests/oracle_runner.py [sf_dir] [name ...]
Prints one line per query: status, rows (spark/duckdb), seconds.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from inspectkit.sources.tables import TABLES  # noqa: E402


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 9)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, sf_dir, names=None, verbose=True):
    import __spark_entry__ as E

    qs = E.queries()
    sqls = E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in names or sorted(qs):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir)
            srows = [tuple(r) for r in sdf.collect()]
            scols = list(sdf.columns)
        except Exception as e:  # noqa: BLE001
            results[name] = ("SPARK_ERROR", str(e)[:300])
            if verbose:
                print(f"{name:34s} SPARK_ERROR {str(e)[:400]}", flush=True)
            continue
        ts = time.time() - t0
        if name not in sqls:
            results[name] = ("ROWS_ONLY", len(srows))
            if verbose:
                print(f"{name:34s} rows-only  spark={len(srows)}  {ts:.1f}s", flush=True)
            continue
        try:
            cur = con.execute(sqls[name])
            drows = cur.fetchall()
            dcols = [d[0] for d in cur.description]
        except Exception as e:  # noqa: BLE001
            results[name] = ("SQL_ERROR", str(e)[:300])
            if verbose:
                print(f"{name:34s} SQL_ERROR {str(e)[:400]}", flush=True)
            continue
        ok_cols = sorted(scols) == sorted(dcols)
        if ok_cols:
            order = sorted(range(len(scols)), key=lambda i: scols[i])
            dorder = [dcols.index(scols[i]) for i in order]
            sn = sorted((tuple(_norm(r[i]) for i in order) for r in srows), key=repr)
            dn = sorted((tuple(_norm(r[i]) for i in dorder) for r in drows), key=repr)
            same = sn == dn
        else:
            same = False
        status = "OK" if same else ("COLS" if not ok_cols else "DIFF")
        if same and not srows:
            status = "EMPTY"  # equal, but says nothing
        results[name] = (status, len(srows), len(drows))
        if verbose:
            print(f"{name:34s} {status:5s} spark={len(srows)} duck={len(drows)}  {ts:.1f}s", flush=True)
            if not ok_cols:
                print("   spark cols", scols, "\n   duck cols ", dcols)
            elif not same:
                a, b = set(sn), set(dn)
                print("   only spark:", list(a - b)[:3])
                print("   only duck: ", list(b - a)[:3])
    return results


if __name__ == "__main__":
    from inspectkit.session import get_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = get_session("local[8]", shuffle_partitions=8)
    res = compare(spark, sf, names)
    bad = [k for k, v in res.items() if v[0] not in ("OK", "ROWS_ONLY")]
    print("FAILED:", bad)
