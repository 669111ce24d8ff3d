"""Run registered queries beside their SQL and compare whole results.

    python tools/compare.py [--sf 0.01] [--only prefix ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from antecede.checks import load  # noqa: E402
from antecede.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(norm(row[i])) for i in order) for row in rows)


def norm(value):
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    return value


def compare(spark, con, name, fn, sql, folder):
    start = time.time()
    df = fn(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return True, f"rows-only {len(rows)} rows", took, 0.0
    start = time.time()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    other = time.time() - start
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(names)}", took, other
    a, b = canonical(rows, df.columns), canonical(expected, names)
    if a == b:
        return True, f"{len(a)} rows", took, other
    left, right = set(a) - set(b), set(b) - set(a)
    detail = f"{len(a)} vs {len(b)} rows; only spark {sorted(left)[:2]}; only sql {sorted(right)[:2]}"
    return False, detail, took, other


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--only", nargs="*", default=[])
    args = parser.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    bad = []
    for name, (fn, sql) in load().items():
        if args.only and not any(name.startswith(p) for p in args.only):
            continue
        try:
            ok, detail, took, other = compare(spark, con, name, fn, sql, folder)
        except Exception as error:  # noqa: BLE001 - report and go on
            ok, detail, took, other = False, f"{type(error).__name__}: {str(error)[:700]}", 0, 0
        if not ok:
            bad.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {name:38s} {took:6.2f}s sql {other:5.2f}s  {detail}", flush=True)
    print(f"{len(bad)} failed: {bad}")


if __name__ == "__main__":
    main()
