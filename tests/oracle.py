"""Compare queries with their SQL on one folder: python tests/oracle.py [folder] [name ...]."""
from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, int):
        return float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(folder):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def compare(spark, con, folder, name, fn, sql):
    df = fn(spark, folder)
    got = rows_of(df.columns, df.collect())
    if sql is None:
        return f"rows={len(got[1])} (no SQL)"
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got == want:
        return f"ok rows={len(got[1])}"
    if got[0] != want[0]:
        return f"MISMATCH columns {got[0]} / {want[0]}"
    missing = [r for r in want[1] if r not in set(got[1])][:3]
    extra = [r for r in got[1] if r not in set(want[1])][:3]
    return f"MISMATCH rows {len(got[1])}/{len(want[1])}\n   spark only {extra}\n   sql only {missing}"


def main():
    import __spark_entry__ as e
    from tsudoi.session import local_session
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark, con = local_session(8), duck(folder)
    queries, sqls = e.queries(), e.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if names and not any(n in name for n in names):
            continue
        start = time.time()
        try:
            out = compare(spark, con, folder, name, fn, sqls.get(name))
        except Exception as err:  # report and go on with the next query
            out = f"ERROR {type(err).__name__}: {str(err)[:900]}"
        bad += not out.startswith(("ok", "rows"))
        print(f"{name:34s} {time.time() - start:6.1f}s {out}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
