"""Run every named query in Spark and its DuckDB statement; compare.

Usage: python tools/check_oracle.py [sf_dir] [key ...]

Prints one line per key: rows (spark/duckdb), column-name match and whether
the order-insensitive row multisets are equal (floats compared to 9
significant digits, nulls unified).
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from churnscope.plans.catalog import CATALOG  # noqa: E402
from churnscope.session import get_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(f"{v:.9g}")
    if hasattr(v, "item"):
        return norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def main(argv):
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:] or list(CATALOG)
    spark = get_session("local[8]", 8)
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from read_parquet('{p}')")
    bad = 0
    for k in keys:
        q = CATALOG[k]
        t0 = time.time()
        try:
            sdf = q.spark(spark, sf)
            srows = [tuple(r) for r in sdf.collect()]
            scols = sdf.columns
        except Exception as e:  # noqa: BLE001
            print(f"{k:28s} SPARK ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        sql = q.oracle()
        if sql is None:
            print(f"{k:28s} rows={len(srows):7d} (rows-only) spark={ts:.1f}s")
            continue
        try:
            res = con.execute(sql)
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"{k:28s} DUCKDB ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        same_cols = sorted(scols) == sorted(dcols)
        same = same_cols and rows_of(scols, srows) == rows_of(dcols, drows)
        flag = "OK " if same else "BAD"
        bad += 0 if same else 1
        print(f"{flag} {k:28s} rows={len(srows):7d}/{len(drows):7d} cols={'=' if same_cols else '!='} "
              f"spark={ts:.1f}s")
        if not same_cols:
            print("   spark only:", sorted(set(scols) - set(dcols)), "duckdb only:", sorted(set(dcols) - set(scols)))
        elif not same:
            a, b = rows_of(scols, srows), rows_of(dcols, drows)
            sa, sb = set(a), set(b)
            print("   spark-only sample:", list(sa - sb)[:2])
            print("   duckdb-only sample:", list(sb - sa)[:2])
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
