"""Compare registered queries with their checking SQL: ``python tools/check.py [sf] [prefix ...]``."""

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from statloom.plans import load_all  # noqa: E402
from statloom.plans.registry import QUERIES  # noqa: E402
from statloom.session import local_session  # noqa: E402
from statloom.sources.tables import TABLE_NAMES  # noqa: E402


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    prefixes = sys.argv[2:]
    folder = f"/root/testdata/{sf}"
    load_all()
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    bad = []
    for name, q in QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            df = q.frame(spark, folder)
            got = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"ERR   {name}: {str(e)[:1200]}")
            continue
        took = time.time() - start
        sql = q.checking_sql()
        if sql is None:
            print(f"rows  {name}: {len(got)} rows {took:.2f}s")
            continue
        try:
            cur = con.execute(sql)
            want = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"SQLER {name}: {str(e)[:1200]}")
            continue
        names = [c for c, _ in q.columns]
        a, b = normal(got, names), normal(want, names)
        if a == b:
            distinct = len(set(a))
            print(f"ok    {name}: {len(a)} rows ({distinct} distinct) {took:.2f}s sql {time.time() - start - took:.2f}s")
        else:
            bad.append(name)
            sa, sb = set(a), set(b)
            print(f"DIFF  {name}: spark {len(a)} sql {len(b)}; cols {sorted(names)}")
            for x in sorted(sa - sb)[:4]:
                print("   spark", x[:700])
            for x in sorted(sb - sa)[:4]:
                print("   sql  ", x[:700])
    print("BAD", bad)


main()
