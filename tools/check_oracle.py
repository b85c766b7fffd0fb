"""Run registered queries next to their SQL oracle and compare rows.

usage: python tools/check_oracle.py [sf folder] [name part ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from hanok.registry import load_all  # noqa: E402
from hanok.session import local_session  # noqa: E402


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return repr(v)


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session("check", 8)
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    bad = 0
    for name, q in load_all().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            df = q.build(spark, folder)
            columns = sorted(df.columns)
            mine = sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())
            spent = time.time() - start
            if q.oracle is None:
                print(f"rows-only {name}: {len(mine)} rows {spent:.1f}s", flush=True)
                continue
            start = time.time()
            cur = con.execute(q.oracle)
            names = [d[0] for d in cur.description]
            rows = cur.fetchall()
            other_time = time.time() - start
            if sorted(names) != columns:
                raise AssertionError(f"columns differ: spark {columns} sql {sorted(names)}")
            at = [names.index(c) for c in columns]
            theirs = sorted(tuple(cell(r[i]) for i in at) for r in rows)
            if mine != theirs:
                only_mine = [r for r in mine if r not in set(theirs)][:2]
                only_theirs = [r for r in theirs if r not in set(mine)][:2]
                raise AssertionError(f"{len(mine)} vs {len(theirs)} rows\n  {columns}\n  spark {only_mine}\n  sql   {only_theirs}")
            print(f"ok {name}: {len(mine)} rows spark {spent:.1f}s sql {other_time:.1f}s", flush=True)
        except Exception as e:  # report and go on with the next query
            bad += 1
            print(f"FAIL {name}: {type(e).__name__}: {str(e)[:1500]}", flush=True)
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
