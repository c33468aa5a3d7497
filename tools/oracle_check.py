"""Run queries in Spark and their oracle SQL in DuckDB; compare rows, columns and values.

usage: python tools/oracle_check.py [--sf-dir DIR] [name ...]
"""

from __future__ import annotations

import argparse
import json
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


DIGITS = 6 if os.environ.get("ORACLE_STRICT") else 5


def canon(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, DIGITS)
    if hasattr(v, "item"):
        return canon(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    if hasattr(v, "tolist"):
        return canon(v.tolist())
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, int):
        return v
    return str(v)


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(canon(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()

    import duckdb

    from threadlens.plans.registry import load_all
    from threadlens.session import local_session

    reg = load_all()
    names = args.names or sorted(reg)
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{args.sf_dir}/{t}.parquet')")
    report = {}
    for name in names:
        e = reg[name]
        t0 = time.time()
        try:
            sdf = e.build(spark, args.sf_dir)
            s_cols = sdf.columns
            s_rows = [tuple(r) for r in sdf.collect()]
        except Exception as ex:  # noqa: BLE001
            report[name] = f"SPARK ERROR {type(ex).__name__}: {str(ex)[:300]}"
            print(name, report[name], flush=True)
            continue
        ts = time.time() - t0
        if e.oracle is None:
            report[name] = f"rows-only {len(s_rows)}"
            print(f"{name}: rows-only, {len(s_rows)} rows ({ts:.1f}s)", flush=True)
            continue
        try:
            res = con.execute(e.oracle)
            d_cols = [c[0] for c in res.description]
            d_rows = res.fetchall()
        except Exception as ex:  # noqa: BLE001
            report[name] = f"DUCKDB ERROR {str(ex)[:300]}"
            print(name, report[name], flush=True)
            continue
        problems = []
        if sorted(s_cols) != sorted(d_cols):
            problems.append(f"columns spark-only={sorted(set(s_cols)-set(d_cols))} duck-only={sorted(set(d_cols)-set(s_cols))}")
        if len(s_rows) != len(d_rows):
            problems.append(f"rows spark={len(s_rows)} duck={len(d_rows)}")
        if not problems:
            a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
            if a != b:
                diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
                problems.append(f"values differ, e.g. {diff}")
        report[name] = "OK" if not problems else "; ".join(problems)
        print(f"{name}: {report[name][:600]} ({len(s_rows)} rows, {ts:.1f}s)", flush=True)
    bad = [n for n, v in report.items() if v != "OK" and not v.startswith("rows-only")]
    print(json.dumps({"checked": len(report), "bad": bad}))
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
