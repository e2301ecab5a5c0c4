"""Run queries on Spark and DuckDB side by side: python -m verification.check [sf_dir] [name ...]"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time

import duckdb

from isotherm.session import local_session
from verification import catalogue

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def value(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(value(x) for x in v)
    if isinstance(v, (dict,)):
        return tuple((k, value(x)) for k, x in v.items())
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, int):
        return v
    return str(v) if not isinstance(v, str) else v


def as_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


def main(argv):
    sf = argv[0] if argv and argv[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv if not a.startswith("/")]
    spark = local_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    sqls, failed = catalogue.oracle_sql(), []
    for name, fn in catalogue.queries().items():
        if names and not any(n in name for n in names):
            continue
        start = time.time()
        try:
            df = fn(spark, sf)
            cols, got = as_rows(df.columns, df.collect())
            took = time.time() - start
            if name not in sqls:
                print(f"{name:32s} rows-only {len(got):7d} {took:6.2f}s")
                continue
            start = time.time()
            cur = con.execute(sqls[name])
            wcols, want = as_rows([c[0] for c in cur.description], cur.fetchall())
            ok = cols == wcols and got == want
            print(f"{name:32s} {'ok ' if ok else 'DIFF'} {len(got):7d} {took:6.2f}s sql {time.time() - start:5.2f}s"
                  + ("  EMPTY" if not got else ""))
            if not ok:
                failed.append(name)
                if cols != wcols:
                    print("   columns", set(cols) ^ set(wcols))
                else:
                    print("   columns", cols, "spark", len(got), "sql", len(want))
                    for a in sorted(set(got) - set(want), key=repr)[:2]:
                        print("   spark", a)
                    for b in sorted(set(want) - set(got), key=repr)[:2]:
                        print("   sql  ", b)
        except Exception as e:  # noqa: BLE001
            failed.append(name)
            print(f"{name:32s} ERROR {type(e).__name__}: {str(e)[:900]}")
        sys.stdout.flush()
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
