"""Run registered queries and their SQL side by side.

    python -m suite.compare [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import time
from decimal import Decimal
from pathlib import Path

import duckdb

from suite.oracles import ORACLES
from suite.queries import QUERIES


def _cell(v):
    if v is None:
        return ("", "")
    if isinstance(v, bool):
        return ("b", str(v))
    if isinstance(v, (int, float, Decimal)):
        f = float(v)
        return ("n", "nan" if math.isnan(f) else f"{f:.9f}")
    return ("s", str(v))


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, sf: str, name: str) -> str:
    """Empty when both sides agree, else what differs."""
    t0 = time.time()
    df = QUERIES[name](spark, sf)
    got = _rows(df.columns, df.collect())
    t1 = time.time()
    con = duckdb.connect()
    for file in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    if name not in ORACLES:
        return f"no SQL ({len(got)} rows)"
    cur = con.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    want = _rows(columns, cur.fetchall())
    t2 = time.time()
    took = f"{len(got)} rows, {t1 - t0:.1f}s / {t2 - t1:.1f}s"
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}"
    if got != want:
        extra = [r for r, w in zip(got, want) if r != w][:1]
        other = [w for r, w in zip(got, want) if r != w][:1]
        return f"DIFFERS {len(got)} / {len(want)} rows: {extra} / {other}"
    print(f"ok   {name}: {took}", flush=True)
    return ""


def main() -> None:
    from billrate.session import local_session

    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark = local_session(8, "compare")
    bad = 0
    for name in args.names or QUERIES:
        try:
            problem = compare(spark, args.sf, name)
        except Exception as e:  # the run goes on to the other queries
            problem = f"FAILED {type(e).__name__}: {str(e)[:600]}"
        if problem:
            bad += 1
            print(f"BAD  {name}: {problem}", flush=True)
    print(f"{bad} problems", flush=True)


if __name__ == "__main__":
    main()
