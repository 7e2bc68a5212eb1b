"""Run every registered query against its SQL in DuckDB and compare the values.

usage: python tools/check.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from plantlens.plans import catalog  # noqa: E402
from plantlens.plans.queries import ORACLES, QUERIES  # noqa: E402
from plantlens.session import local_session  # noqa: E402


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(repr(r[i]) for i in order) for r in rows))


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    duck = duckdb.connect()
    for t in catalog.TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    bad, total = [], 0.0
    for name, fn in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            got = canonical(df.columns, [tuple(r) for r in df.collect()])
        except Exception as e:  # noqa: BLE001 - report and go on
            bad.append(name)
            print(f"ERROR  {name}: {str(e)[:600]}", flush=True)
            continue
        took = time.time() - t0
        total += took
        if name not in ORACLES:
            print(f"rows   {name} {len(got[1])} {took:.2f}s", flush=True)
            if not got[1]:
                bad.append(name)
            continue
        try:
            cur = duck.execute(ORACLES[name])
            want = canonical([c[0] for c in cur.description], cur.fetchall())
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"SQL    {name}: {str(e)[:600]}", flush=True)
            continue
        if got == want and got[1]:
            print(f"ok     {name} {len(got[1])} {took:.2f}s", flush=True)
            continue
        bad.append(name)
        a, b = set(got[1]), set(want[1])
        print(f"DIFF   {name} spark={len(got[1])} sql={len(want[1])} only-spark={len(a - b)} only-sql={len(b - a)} {took:.2f}s", flush=True)
        print("   cols", got[0])
        for r in sorted(a - b)[:3]:
            print("   spark", r)
        for r in sorted(b - a)[:3]:
            print("   sql  ", r)
    print(f"total {total:.1f}s, {len(bad)} bad: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
