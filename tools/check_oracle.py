"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

usage: python tools/check_oracle.py [sf_dir] [name ...]

Compares row count, column names and an order-insensitive hash of the
values (floats rounded to 9 significant digits), like the round checker.
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shiftscope.plans.catalog import load_all  # noqa: E402
from shiftscope.plans.compare import compare, duck  # noqa: E402
from shiftscope.session import build_session  # noqa: E402


def main():
    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf_dir, args = args[0], args[1:]
    reg = load_all()
    names = args or list(reg)
    spark = build_session("local[8]")
    con = duck(sf_dir)
    bad = 0
    for name in names:
        q = reg[name]
        t0 = time.time()
        try:
            df = q.build(spark, sf_dir)
            if q.sql is None:
                n = df.count()
                print(f"{name:24s} rows={n} (no oracle) {time.time() - t0:.1f}s")
                continue
            ok, detail = compare(df, con, q.sql)
        except Exception as e:  # noqa: BLE001
            print(f"{name:24s} ERROR {str(e)[:400]}")
            bad += 1
            continue
        if not ok:
            bad += 1
        print(f"{name:24s} {'OK' if ok else 'MISMATCH'} {detail[:600]} {time.time() - t0:.1f}s")
    print(f"{len(names) - bad}/{len(names)} ok")


if __name__ == "__main__":
    main()
