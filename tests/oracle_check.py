"""Run the registered queries beside their SQL in DuckDB; usable from pytest and by hand.

    python tests/oracle_check.py [folder] [name-part ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from loomgraph.fixtures import BASE_TABLES  # noqa: E402
from loomgraph.plans import PLANS  # noqa: E402
from loomgraph.session import build_session  # noqa: E402


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr), [columns[i] for i in order]


def connect(folder: str):
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def check(spark, con, folder: str, name: str) -> tuple[bool, str]:
    t0 = time.time()
    df = PLANS[name](spark, folder)
    got, cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if PLANS[name].sql is None:
        return True, f"rows={len(got)} spark={t1 - t0:.1f}s (no SQL)"
    cur = con.execute(PLANS[name].sql)
    want, wcols = rows_of([c[0] for c in cur.description], cur.fetchall())
    msg = f"rows={len(got)} spark={t1 - t0:.1f}s duckdb={time.time() - t1:.1f}s"
    if cols != wcols:
        return False, f"{msg} columns {cols} != {wcols}"
    if got != want:
        a = [r for r in got if r not in set(want)][:2] if len(got) < 50000 else []
        b = [r for r in want if r not in set(got)][:2] if len(want) < 50000 else []
        return False, f"{msg} sql rows={len(want)} spark only={str(a)[:700]} sql only={str(b)[:700]}"
    return True, msg


if __name__ == "__main__":
    args = sys.argv[1:]
    folder = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    session = build_session()
    session.sparkContext.setLogLevel("ERROR")
    link = connect(folder)
    bad = 0
    for key in PLANS:
        if args and not any(a in key for a in args):
            continue
        try:
            ok, info = check(session, link, folder, key)
        except Exception as e:  # noqa: BLE001
            ok, info = False, f"{type(e).__name__}: {str(e)[:900]}"
        bad += not ok
        print(("ok  " if ok else "FAIL"), key, info, flush=True)
    print("failures:", bad)
