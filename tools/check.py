"""Compare registered queries with their SQL on one data folder.

    python tools/check.py [sf_dir] [name | @group ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from importlib import import_module

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from pagelake import catalog  # noqa: E402
from pagelake.session import build_session  # noqa: E402


def canon(v):
    if v is None:
        return ("", "")
    if isinstance(v, bool):
        return ("b", str(v))
    if isinstance(v, float):
        if math.isnan(v):
            return ("f", "nan")
        return ("n", repr(round(v, 6) + 0.0))
    if isinstance(v, int):
        return ("n", repr(round(float(v), 6)))
    if isinstance(v, (list, tuple)):
        return ("l", tuple(canon(x) for x in v))
    return (type(v).__name__[:1], str(v))


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def main(argv):
    sf = argv[0] if argv else "/root/testdata/sf0.001"
    wanted = [a for a in argv[1:] if not a.startswith("@")]
    for group in (a[1:] for a in argv[1:] if a.startswith("@")):
        wanted += import_module(f"pagelake.catalog.{group}").QUERIES
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    qs, sqls = catalog.queries(), catalog.checks()
    bad = []
    for name, fn in qs.items():
        if wanted and name not in wanted:
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            got = [tuple(r) for r in df.collect()]
            t1 = time.time() - t
            if name not in sqls:
                print(f"rows {name:26} {len(got):8} {t1:6.2f}s")
                continue
            t = time.time()
            cur = con.execute(sqls[name])
            cols = [d[0] for d in cur.description]
            want = cur.fetchall()
            t2 = time.time() - t
            if sorted(cols) != sorted(df.columns):
                raise AssertionError(f"columns {sorted(df.columns)} != {sorted(cols)}")
            a, b = rows_of(df.columns, got), rows_of(cols, want)
            ok = a == b
            print(f"{'ok  ' if ok else 'DIFF'} {name:26} {len(a):8} {len(b):8} {t1:6.2f}s {t2:6.2f}s", flush=True)
            if not ok:
                bad.append(name)
                sa, sb = set(a), set(b)
                print("   cols", sorted(cols))
                for x in sorted(sa - sb)[:3]:
                    print("   spark", [y[1] for y in x])
                for x in sorted(sb - sa)[:3]:
                    print("   sql  ", [y[1] for y in x])
        except Exception as e:  # report and go on
            bad.append(name)
            print(f"FAIL {name}: {type(e).__name__}: {str(e)[:900]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
